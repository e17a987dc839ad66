"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, remove


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component), the component being its least node. Nodes without edges don't occur.

    Minima are pre-aggregated before each shuffle and joined back, so a node with very many neighbours is never
    gathered in one place. Each round is written to the shared folder; edges never come to the driver. Null ends and
    self-loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, next_path = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        remove(spark, path)
        now, path = after, next_path
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
