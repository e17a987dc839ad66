"""A corpus through five of the operators: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns a DataFrame; ``run`` writes
each one's result as Parquet in the shared folder and reads it again for the next.

In every stage null and empty texts are texts without words (kept by all), null ids are ids like others, repeated rows are
documents of their own, an empty table gives no rows, and other columns, clashing names too, are left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from tokenloom.llm._spark import materialize, pick
from tokenloom.llm.token_files import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity operator scores 0.5 or more; a score of just 0.5 goes."""
    found = toxicity.score(docs, toxicity.trained(spark, sf_dir, docs), carry=COLUMNS)
    return found.filter("score < 0.5").select("carry.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of the least id (null ids last), the first of those that share it.

    Rows are numbered and written first, so each is decided on by its own number, whatever its id. Texts without words
    are near-duplicates of each other.
    """
    numbered, _ = materialize(pick(docs, **{c: c for c in COLUMNS}).withColumn("row", F.monotonically_increasing_id()), "rows")
    found, _ = materialize(simhash.near_duplicates(numbered, id_col="row").select(F.col("id").alias("row"), "component"), "components")
    groups, _ = materialize(found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"), "groups")
    members, _ = materialize(numbered.select("row", "doc_id").join(found.join(groups, "component"), "row"), "members")
    # tables of their own, so that joins on a group that holds much of the corpus can be split
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("kept"))
    first, _ = materialize(first, "first")
    others = members.join(first, "component").filter("row <> kept.row").select("row")
    return numbered.join(others, "row", "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 100-byte strings, halves of characters dropped, too; documents with nothing left go.

    Of equal strings the one in the row of the least id stays, null ids before all, as the operator has it.
    """
    found = suffix_dedup.dedup(docs, as_text=True, carry=COLUMNS)
    touched = F.size("spans") > 0
    text = F.when(touched, F.col("kept")).otherwise(F.col("carry.text"))
    n_chars = F.when(touched, F.char_length("kept").cast("long")).otherwise(F.col("carry.n_chars"))
    return found.filter(~touched | (F.col("kept") != "")).select("carry.doc_id", text.alias("text"), "carry.lang", "carry.source", n_chars.alias("n_chars"))


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.filter("size(spans) = 0").select("carry.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row for each piece of a document; a text without words is an end id."""
    found = packing.pack_documents(docs, tokenizer_path(packing.TOKENIZER))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", keep_clean),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", keep_unseen),
    ("best-fit packing", pack),
]
#: The stages learn, hash, sort bytes and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
