"""Corpus files in, result files out."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import INFERENCE_LANGUAGES, LANGUAGES, TOKENS

CORPUS = f"sentence string, tokens {TOKENS}, doc {TOKENS}"


def _existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for code, p in paths.items():
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out[code] = p
        else:
            print(f"Warning: {p} not found, skipping")
    return out


def _part(spark: SparkSession, code: str, path: str, first: int | None) -> DataFrame:
    """One file's rows; a bad row ends the read. With ``first`` only as many, in the file's order: that of splits and their lines."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    if first is not None:
        lines = lines.select("value", F.input_file_block_start().alias("_at"), F.monotonically_increasing_id().alias("_line")).orderBy("_at", "_line").limit(first)
    got = lines.select(F.from_json("value", CORPUS, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return got.withColumn("language", F.lit(code))


def _read(spark: SparkSession, paths: dict[str, str], first: int | None = None) -> DataFrame:
    df = None
    for code, p in _existing(spark, paths).items():
        part = _part(spark, code, p, first)
        df = part if df is None else df.unionByName(part)
    if df is None:
        df = spark.createDataFrame([], f"{CORPUS}, language string")
    empty = F.array().cast(TOKENS)
    return df.select("language", "sentence", F.coalesce("tokens", "doc", empty).alias("tokens"))


def from_sentences(spark: SparkSession, sentences: list[str], language: str = "eng") -> DataFrame:
    """A list of sentences as (sent_id, language, sentence), numbered from 0."""
    return spark.createDataFrame([(i, language, s) for i, s in enumerate(sentences)], "sent_id long, language string, sentence string")


def from_samples(spark: SparkSession, samples: list[dict], language: str) -> DataFrame:
    """Samples in memory, as a corpus file has them: (language, sentence, tokens)."""
    empty = F.array().cast(TOKENS)
    rows = [(s.get("sentence"), [[t[c] for c in ("text", "whitespace", "pos", "lemma", "dep", "head")] for t in s.get("tokens", s.get("doc", []))]) for s in samples]
    return spark.createDataFrame(rows, f"sentence string, tokens {TOKENS}").select(F.lit(language).alias("language"), "sentence", F.coalesce("tokens", empty).alias("tokens"))


def first_row(df: DataFrame):
    """One sample, to look at; None where there is none."""
    return df.limit(1).first()


def known_language(code: str, default: str = "eng") -> str:
    """The code in lower case, the default for unknown ones."""
    code = code.strip().lower()
    return code if code in INFERENCE_LANGUAGES else default


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; a machine-local one only where the session runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_corpus(spark: SparkSession, folder: str, languages: list[str] | None = None, name: str = "{folder}/cleaned_{code}.jsonl") -> DataFrame:
    """cleaned_{code}.jsonl of each language; missing files are named and left out, a bad row ends the read."""
    return _read(spark, {c: name.format(folder=folder.rstrip("/"), code=c) for c in languages or LANGUAGES})


def read_test_corpus(spark: SparkSession, folder: str, languages: list[str] | None = None, max_samples: int = 100) -> DataFrame:
    """The first rows of each {code}.jsonl, in the file's order."""
    return _read(spark, {c: f"{folder.rstrip('/')}/{c}.jsonl" for c in languages or INFERENCE_LANGUAGES}, max_samples)


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def latest_checkpoint(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The path checkpoint-N of largest N; one row, null if there is none."""
    n = F.regexp_extract(F.col(path_col), r"checkpoint-(\d+)$", 1)
    return paths.withColumn("_n", F.when(n != "", n.cast("long"))).filter("_n is not null").agg(F.max_by(path_col, "_n").alias(path_col), F.max("_n").alias("step"))


def to_json(tokens_col: str = "tokens"):
    return F.to_json(F.struct(F.col(tokens_col).alias("tokens")))


def from_json(text):
    return F.from_json(text, f"tokens {TOKENS}")["tokens"]


def write_results(spark: SparkSession, results: dict, path: str) -> None:
    """Evaluation results without the text report, as one file in any store that Spark reaches."""
    text = json.dumps({k: v for k, v in results.items() if k != "pos_classification_report"}, indent=2, ensure_ascii=False)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
