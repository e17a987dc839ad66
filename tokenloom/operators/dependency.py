"""Tree patterns: a node matches if lemmas agree and each child of the pattern has a matching direct child under its relation.

All patterns go at once. Nodes join patterns on lemma (broadcast if Spark's statistics allow it), once; candidates move to
their sentence's partition, once. Each level of the patterns, from the deepest up, is then an aggregation in place. No table
is read twice, so trees are built once however deep the patterns are.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TREE_PATTERN


@dataclass(frozen=True)
class Tree:
    """A pattern to write down: Tree("love", obj=Tree("dog")); relations with ':' go in a dict as the second argument."""

    lemma: str
    children: tuple[tuple[str, Tree], ...] = ()

    @staticmethod
    def of(lemma: str, *children: tuple[str, Tree]) -> Tree:
        return Tree(lemma, tuple(children))


def pattern_rows(patterns: list[tuple[str, Tree]]) -> list[tuple]:
    """Rows of TREE_PATTERN. Of children with the same relation the last counts, as relations are keys."""
    rows = []
    for index, (label, tree) in enumerate(patterns):
        stack, number = [(tree, None, None)], 0
        while stack:
            node, parent, dep = stack.pop()
            rows.append((index, label, number, parent, dep, node.lemma))
            stack += [(child, number, d) for d, child in dict(node.children).items()]
            number += 1
    return rows


def pattern_table(spark: SparkSession, patterns: list[tuple[str, Tree]]) -> DataFrame:
    return spark.createDataFrame(pattern_rows(patterns), TREE_PATTERN)


RANKED = "pattern_index int, label string, pnode int, pparent int, pdep string, lemma string, kids int, height int, pheight int"


def _rank(pattern: pd.DataFrame) -> pd.DataFrame:
    """One pattern's nodes with the number of their children, their height and their parent's (a leaf's height is 0).

    Of children with the same relation the last counts; what hangs from the others goes.
    """
    rows = sorted(pattern[["pattern_index", "label", "pnode", "pparent", "pdep", "lemma"]].itertuples(index=False, name=None), key=lambda r: r[2])
    below: dict[int, dict[str, tuple]] = {}
    first = None
    for r in rows:
        if pd.isna(r[3]):
            first = r
        else:
            below.setdefault(int(r[3]), {})[r[4]] = r
    order = [] if first is None else [first]
    for r in order:
        order += below.get(r[2], {}).values()
    height: dict[int, int] = {}
    for r in reversed(order):
        height[r[2]] = 1 + max((height[c[2]] for c in below.get(r[2], {}).values()), default=-1)
    out = [(*r[:3], None if r is first else int(r[3]), *r[4:], len(below.get(r[2], {})), height[r[2]], None if r is first else height[int(r[3])]) for r in order]
    return pd.DataFrame(out, columns=[c.split()[0] for c in RANKED.split(", ")]).astype({"pparent": "Int32", "pheight": "Int32"})


def find_all(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sent_id, pre, node, pattern_index, matched_label): pre and index give the order of a walk from the root down."""
    ranked = patterns.groupBy("pattern_index").applyInPandas(_rank, RANKED)
    top = ranked.agg(F.max("height")).first()[0] or 0
    key = ("sent_id", "pre", "pattern_index", "pnode")
    held = ("node", "up", "dep", "pparent", "pdep", "label", "kids", "height", "pheight")
    rows = nodes.join(ranked, "lemma").select(*key, *held, (F.col("kids") == 0).alias("ok"))
    if top:
        rows = rows.repartition("sent_id")
    for level in range(1, top + 1):
        # each row stays; a match also tells the node above it that the pattern's child is there
        own = F.struct("pre", "pnode", F.struct(*held, "ok").alias("own"), F.lit(None).cast("int").alias("child"))
        above = F.struct(F.col("up").alias("pre"), F.col("pparent").alias("pnode"), F.lit(None).cast(own_type(rows, held)).alias("own"), F.col("pnode").alias("child"))
        tells = F.col("ok") & (F.col("pheight") == level) & F.col("up").isNotNull() & (F.col("dep") == F.col("pdep"))
        sent = F.explode(F.when(tells, F.array(own, above)).otherwise(F.array(own))).alias("m")
        told = rows.select("sent_id", "pattern_index", sent).select("sent_id", "m.pre", "pattern_index", "m.pnode", "m.own", "m.child")
        told = told.groupBy(*key).agg(F.max("own").alias("own"), F.collect_set("child").alias("children")).filter("own is not null")
        ok = F.when(F.col("own.height") == level, F.size("children") == F.col("own.kids")).otherwise(F.col("own.ok"))
        rows = told.select(*key, *[F.col(f"own.{c}").alias(c) for c in held], ok.alias("ok"))
    return rows.filter("pparent is null and ok").select("sent_id", "pre", "node", "pattern_index", F.col("label").alias("matched_label"))


def own_type(rows: DataFrame, held: tuple[str, ...]) -> T.StructType:
    return T.StructType([rows.schema[c] for c in (*held, "ok")])


def contains(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Ids of the sentences with any match."""
    return find_all(nodes, patterns).select("sent_id").distinct()


def find_multiple(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sent_id, pattern_index, matched_label, nodes): each pattern's nodes in a sentence, in the order of a walk; only patterns that match."""
    found = find_all(nodes, patterns).groupBy("sent_id", "pattern_index", "matched_label").agg(F.array_sort(F.collect_list(F.struct("pre", "node"))).alias("m"))
    return found.select("sent_id", "pattern_index", "matched_label", F.col("m.node").alias("nodes"))


def by_pattern(matches: DataFrame) -> DataFrame:
    """How many nodes each pattern matches, in how many sentences."""
    return matches.groupBy("pattern_index", "matched_label").agg(F.count("*").alias("n_nodes"), F.countDistinct("sent_id").alias("n_sentences"))
