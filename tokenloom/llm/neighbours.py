"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, pick

PART = 16  # bits of a substring
SCAN = 64  # queries scored at once against a whole shard


@dataclass
class Codes:
    """Rotations learned on a sample (ITQ), the largest norm of all rows, and the radius to search."""

    rotations: np.ndarray  # (dimension + 1, bits)
    top: float
    radius: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate makes all rows as long as the longest, so the largest inner product is the least angle."""
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1) / self.top

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(self.lift(x) @ self.rotations > 0, axis=1).view(np.uint64)

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotations[:-1] > 0, axis=1).view(np.uint64)


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Blocks of orthogonal directions, each turned so that the sample's signs lose least (iterative quantisation)."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ v
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def learn(sample: np.ndarray, rows: int, top: float, k: int, bits: int, recall: float, queries: int = 400) -> Codes:
    """Fit on a bounded sample: rotations, and the radius that holds this share of the neighbours.

    A sample of one row in s has the k / s nearest of its rows where all rows have their k nearest.
    """
    codes = Codes(np.zeros((sample.shape[1] + 1, bits)), top, bits)
    lifted = codes.lift(sample)
    codes.rotations = learn_rotations(lifted, bits)
    ask = np.random.default_rng(2).permutation(len(sample))[:queries]
    near = max(1, -(-k * len(sample) // max(rows, 1)))
    all_codes, ask_codes = codes.of_rows(sample), codes.of_queries(sample[ask])
    far = []
    for i, q in zip(ask.tolist(), ask_codes, strict=True):
        score = sample @ sample[i]
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(near, len(sample) - 1)]
        far.append(np.bitwise_count(all_codes[best] ^ q).sum(axis=1))
    far = np.concatenate(far) if far else np.zeros(0)
    codes.radius = int(np.ceil(np.quantile(far, recall))) + 1 if len(far) else bits
    return codes


@lru_cache(maxsize=32)
def masks(radius: int) -> np.ndarray:
    """All substrings within so many bits of 0."""
    every = np.arange(1 << PART, dtype=np.int64)
    return every[np.bitwise_count(every) <= radius]


class MultiIndex:
    """A table of row numbers for each substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint16)
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(parts.shape[1])]
        keys = [np.unique(parts[:, j], return_counts=True) for j in range(parts.shape[1])]
        self.keys, self.count = [k[0].astype(np.int64) for k in keys], [k[1] for k in keys]
        self.start = [np.r_[0, np.cumsum(c)] for c in self.count]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within the radius. By the pigeonhole principle, radii of the parts that sum to radius - parts + 1 will do."""
        parts = code.view(np.uint16)
        n = len(parts)
        spare = radius - n + 1
        seen = np.zeros(len(self.codes), bool)
        for j in range(n):
            r = spare // n + (j < spare % n)
            if r < 0:
                continue
            if r >= PART:
                seen[:] = True
                break
            keys = self.keys[j]
            if len(masks(r)) > len(keys):  # fewer substrings occur than there are within the radius: look at those
                seen[self.order[j][np.repeat(np.bitwise_count(keys ^ int(parts[j])) <= r, self.count[j])]] = True
                continue
            probe = masks(r) ^ int(parts[j])
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            at = at[keys[at] == probe]
            lo, size = self.start[j][at], self.count[j][at]
            seen[self.order[j][np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _nearest(ids, vectors, query_id, query, rows, k):
    """The k rows of largest inner product, in double precision and row by row, so that equal vectors score equally."""
    rows = rows[ids[rows] != query_id]
    score = (vectors[rows] * query).sum(axis=1)
    if len(rows) > 4 * k:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[keep], score[keep]
    order = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][order], score[order]


def _scan(ids, vectors, query_ids, queries, k):
    """The k nearest of all rows for each query: scores by matrix product leave out most rows, _nearest decides on the rest."""
    longest = np.sqrt((vectors * vectors).sum(axis=1).max(initial=0))
    out = []
    for a in range(0, len(queries), SCAN):
        scores = queries[a : a + SCAN] @ vectors.T
        for i, q, score in zip(query_ids[a : a + SCAN], queries[a : a + SCAN], scores, strict=True):
            score[ids == i] = -np.inf
            slack = 1e-9 * longest * np.sqrt((q * q).sum())
            rows = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - slack) if len(score) > k else np.arange(len(score))
            out.append(_nearest(ids, vectors, i, q, rows, k))
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _search(codes: Codes, dimension: int, k: int, whole: bool = False):
    """Rows come by shard, its vectors before the queries (asks). A shard is indexed once; queries pass by in batches.

    With ``whole`` queries meet every row of the shard, not only those within the radius.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1]), True]) if len(numbers) else [0]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(a, z - a)
                if numbers[a] != shard:
                    shard, held, index = numbers[a], [], None
                if not asks[a]:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("vector"), dimension)))
                    continue
                if index is None:
                    ids = np.concatenate([np.zeros(0, np.int64), *(h[0] for h in held)])
                    vectors = np.concatenate([np.zeros((0, dimension)), *(h[1] for h in held)])
                    index = whole or MultiIndex(codes.of_rows(vectors))
                queries, query_ids = _matrix(part.column("vector"), dimension), part.column("id").to_pylist()
                if whole:
                    found = _scan(ids, vectors, query_ids, queries, k)
                else:
                    found = [
                        _nearest(ids, vectors, i, q, index.within(c, codes.radius), k)
                        for i, q, c in zip(query_ids, queries, codes.of_queries(queries), strict=True)
                    ]
                off = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(-np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[0] for f in found]))], ["less", "id"])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(off, pairs)], ["query", "near"])

    return run


def nearest_neighbours(
    rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, bits: int = 128,
    recall: float = 0.975, sample_rows: int = 20_000, shard_rows: int = 50_000,
) -> DataFrame:
    """(query, rank, id, score): for each row for which ``is_query`` holds of its id, its k nearest other rows found.

    Nearest: largest inner product; ties go to the smaller id. The codes and the radius are fitted on the ``sample_rows``
    rows of least hash of id; every row is indexed, in shards of at most about ``shard_rows``, and every query meets every
    shard (a stated set of queries against all rows, in blocks). Queries that find fewer than k rows within the radius (or
    than there are) are compared with all rows. Rows with a null id, with a null or zero vector, with null or non-finite
    components, or with another length than most, take no part; vectors of any length are taken whole, other columns,
    clashing names too, left behind. Rows that repeat an id are candidates as often as they come, but no neighbours of each other; such an id asks once, with its least vector.
    """
    spark = rows.sparkSession
    rows = pick(rows, id=id_col, vector=vector_col).select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    of_length = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "d").first()
    if of_length is None:
        return spark.createDataFrame([], "query long, rank int, id long, score double")
    d, n, top = of_length
    rows = rows.filter(F.size("vector") == d)
    taken = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample_rows).select("vector")
    sample = np.array([r.vector for r in taken.toLocalIterator()])
    codes = learn(sample, n, top * (1 + 1e-9), k, bits, recall)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard_rows), min(width, -(-n // 4000)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))

    def search(queries: DataFrame, whole: bool) -> DataFrame:
        asks = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
        both = dealt.unionByName(asks).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "asks", "id")
        found = both.mapInArrow(_search(codes, d, k, whole), "query long, near array<struct<less:double,id:bigint>>")
        return found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # a list from each shard

    queries = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector"), F.count("*").alias("times"))
    best, _ = materialize(search(queries.drop("times"), False), "neighbours")
    few = best.filter(F.size("near") < k).join(queries, F.col("query") == F.col("id"))
    short = few.filter(F.size("near") < F.lit(n) - F.col("times")).select("id", "vector")
    if not short.isEmpty():
        best = best.join(short, F.col("query") == F.col("id"), "left_anti").unionByName(search(short, True))
    flat = best.select("query", F.posexplode("near").alias("at", "n"))
    return flat.select("query", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("id"), (-F.col("n.less")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    found = nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
