"""A deterministic stand-in for the model: annotated sentences, raw responses with typical faults, predictions with errors.

Everything is a built-in expression, so that the same can be said in SQL (see queries.py). Benchmarks save the tables first
(``use_saved``), so that they time the operators and not this stand-in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import once, spread
from ..operators import codec
from ..schema import END_MARKER, MARKER, TOKENS, WHITESPACE, WHITESPACE_VARIANTS

TOKEN_RE = r"(?:[\p{L}\p{N}]+|[^ \x09\x0B\x0C\x0D\p{L}\p{N}]) ?"
WORD_POS = ("NOUN", "VERB", "ADJ", "DET", "ADP")
WORD_DEP = ("nsubj", "obj", "obl", "det", "amod", "advmod")
#: Every code of white space that a response can hold.
CODES = [*WHITESPACE.values(), *WHITESPACE_VARIANTS]

_saved: dict[str, str] = {}


def use_saved(**paths: str) -> None:
    """Tables (annotated, responses, predictions) that are there already, as Parquet; without any, they are made each time."""
    _saved.clear()
    _saved.update(paths)


def _kept(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(make)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(_saved[make.__name__]) if make.__name__ in _saved else make(spark, sf_dir)

    return get


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, language, sentence): the lines of all documents, numbered by document and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "sentence")).filter("sentence <> ''")
    code = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "de", "deu").when(F.col("lang") == "es", "spa").otherwise(F.col("lang"))
    return spread(lines.select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("sent_id"), code.alias("language"), "sentence"), "sent_id")


@_kept
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``tokens``: heads make a heap, the first token is the root, labels follow from length and place.

    In sentences of ids by 13 the root's head is its child, a cycle; in those by 17 the third token says it is a root, too.
    """
    found = F.regexp_extract_all("sentence", F.lit(TOKEN_RE), F.lit(0))
    word = lambda x: F.rtrim(x)
    is_word = lambda x: x.rlike(r"^[\p{L}\p{N}]")
    pos = lambda x: F.when(~is_word(x), "PUNCT").when(x.rlike(r"^[0-9]+ ?$"), "NUM").otherwise(F.element_at(F.array(*map(F.lit, WORD_POS)), F.length(word(x)) % 5 + 1))
    dep = lambda x, i: F.when((i == 0) | ((i == 2) & (F.col("sent_id") % 17 == 0)), "root").when(~is_word(x), "punct").otherwise(F.element_at(F.array(*map(F.lit, WORD_DEP)), (i + 1) % 6 + 1))
    token = lambda x, i: F.struct(
        word(x).alias("text"), F.when(F.endswith(x, F.lit(" ")), " ").otherwise("").alias("whitespace"), pos(x).alias("pos"),
        F.lower(word(x)).alias("lemma"), dep(x, i).alias("dep"), F.when((i == 0) & (F.col("sent_id") % 13 == 0) & (F.size("_found") > 1), 2).otherwise(F.floor((i + 1) / 2)).cast("int").alias("head"),
    )
    df = sentences(spark, sf_dir).withColumn("_found", found)
    return once(df, "tokens", F.transform("_found", token).cast(TOKENS)).drop("_found")


def faulty(clean, sent_id):
    """The response with one of ten faults, by the id's last digit; 9 has another code of white space, each in turn."""
    end = f"\n\n{END_MARKER}"
    k = sent_id % 10
    out = F.when(k == 0, F.translate(clean, "éèêöüäñó", "eeeouano"))
    out = out.when(k == 1, F.replace(clean, F.lit(end), F.lit(f"\n99\t.\tnone\tPUNCT\t.\tpunct\t1{end}")))
    out = out.when(k == 2, F.replace(clean, F.lit(f"{MARKER}\n\n"), F.lit("")))
    out = out.when(k == 3, F.replace(clean, F.lit("\troot\t0"), F.lit("\troot\tx0")))
    out = out.when(k == 4, F.replace(clean, F.lit("\tDET\t"), F.lit("\tFOO\t")))
    out = out.when(k == 5, F.replace(clean, F.lit(end), F.lit("")))
    out = out.when(k == 6, F.replace(clean, F.lit("\n2\t"), F.lit("\n2 ")))
    out = out.when(k == 7, F.replace(clean, F.lit(end), F.lit(f"\n99\t !\tnone\tPUNCT\t!\tpunct\t1{end}")))
    out = out.when(k == 8, F.replace(clean, F.lit("\troot\t"), F.lit("\tROOT\t")))
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.floor(sent_id / 10) % len(CODES) + 1).cast("int"))
    return out.otherwise(F.replace(clean, F.lit("\tnone\t"), F.concat(F.lit("\t"), code, F.lit("\t"))))


@_kept
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = annotated(spark, sf_dir)
    return df.select("sent_id", "language", "sentence", faulty(codec.encode(F.col("tokens")), F.col("sent_id")).alias("response"))


@_kept
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation with errors: every 7th token's part of speech, every 11th lemma, every 5th relation; sentences of ids by 3 lack their last token."""
    wrong = lambda c, i, n, value: F.when((i + F.col("sent_id")) % n == 0, value).otherwise(c)
    short = F.slice("tokens", 1, F.greatest(F.size("tokens") - F.when(F.col("sent_id") % 3 == 0, 1).otherwise(0), F.lit(0)))
    tokens = F.transform(
        short,
        lambda t, i: F.struct(
            t["text"].alias("text"), t["whitespace"].alias("whitespace"), wrong(t["pos"], i, 7, F.lit("X")).alias("pos"),
            wrong(t["lemma"], i, 11, F.concat(t["lemma"], F.lit("x"))).alias("lemma"), wrong(t["dep"], i, 5, F.lit("dep")).alias("dep"), t["head"].alias("head"),
        ),
    )
    return annotated(spark, sf_dir).select("sent_id", tokens.cast(TOKENS).alias("tokens"))
