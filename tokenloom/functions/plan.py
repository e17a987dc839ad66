"""Plan shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row.

    Catalyst merges projections, so an array that a lambda refers to would be computed again for each of its elements. A
    generator of one row is no projection and keeps it apart; it doesn't shuffle, and works on streams.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by a key if it is read in fewer pieces than half of them, as one small file is; else as it is.

    A table of many splits already keeps every core busy and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() < cores else df
