"""What the operators share on the Spark side: scratch tables in the shared folder and column selection."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests, a single machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "tokenloom-scratch")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables through Hadoop, so any store will do."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: write df as Parquet to the shared folder and read it again. Survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize_by(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """materialize() in buckets of a column: later joins on it with as many partitions don't move these rows again.

    Buckets are a table's property, so the catalog knows the table by a name of its own while it is read; the files stay.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"tokenloom_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found, path


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names; extra columns, clashing ones too, are left behind.

    A name that occurs more than once (or in another case) resolves to its first exact occurrence.
    """
    names = df.columns
    if len({n.lower() for n in names}) < len(names):
        df = df.toDF(*[f"_c{i}" for i in range(len(names))])
        return df.select(*[F.col(f"_c{names.index(c)}").alias(new) for new, c in columns.items()])
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in columns.items()])


def pick_carry(df: DataFrame, carry: Sequence[str], **columns: str) -> DataFrame:
    """pick(), and with names in ``carry`` a struct column of that name which holds them."""
    if not carry:
        return pick(df, **columns)
    got = pick(df, **columns, **{f"carry_{c}": c for c in carry})
    return got.select(*columns, F.struct(*[F.col(f"carry_{c}").alias(c) for c in carry]).alias("carry"))


def carried(df: DataFrame, schema: str) -> T.StructType:
    """The schema of a mapInArrow whose rows keep the input's carry column, if it has one."""
    out = T.StructType.fromDDL(schema)
    return out.add(df.schema["carry"]) if "carry" in df.columns else out


def carry_columns(piece: pa.RecordBatch) -> tuple[list[pa.Array], list[str]]:
    return ([piece.column("carry")], ["carry"]) if "carry" in piece.schema.names else ([], [])


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal rows out by a key with the session's number of shuffle partitions; AQE may merge small ones, never split a key."""
    return df.repartition(*keys)


def partitions_for(df: DataFrame, most_bytes: int) -> int:
    """As many partitions as keep each at about ``most_bytes`` of what Spark expects df to read, the session's number at least."""
    expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(fewest, -(-expected // most_bytes)) if expected < 1 << 60 else fewest  # plans of unknown size count as endless
