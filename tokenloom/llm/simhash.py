"""SimHash near-duplicates, found by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, pieces, runs, utf8
from ._spark import materialize, pick
from .components import components

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
#: Each byte's bits as the eight bytes of a number.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def batch_fingerprints(column: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of each text: bit set if it is set in over half of the shingles' hashes."""
    buf, off = utf8(column)
    buf = LOWER[buf]
    inside = ~SPACE[buf]
    start, end, first = runs(inside, off)
    length = end - start
    words = np.diff(first)
    out = np.full(int(length.sum()) + len(start), 0x20, np.uint8)
    out[np.arange(int(length.sum())) + np.repeat(np.arange(len(start)), length)] = buf[inside]
    at = np.cumsum(length + 1) - length - 1
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    total = int(count.sum())
    fingerprints = np.zeros(len(words), np.uint64)
    if not total:
        return fingerprints
    before = np.cumsum(count) - count
    word = np.arange(total) + np.repeat(first[:-1] - before, count)
    last = np.minimum(word + shingle, np.repeat(first[1:], count)) - 1
    lo, hi = at[word], at[last] + length[last]
    data, digest = out.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:z], seed) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, total)
    full = np.flatnonzero(count)
    blocks = (count[full] + 254) // 255  # sums of up to 255 ones fit a byte
    block_start = np.repeat(before[full], blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    sums = np.add.reduceat(BITS[hashes.view(np.uint8).reshape(-1, 8)], block_start, axis=0)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(len(block_start), 64).astype(np.uint32), np.cumsum(blocks) - blocks, axis=0)
    fingerprints[full] = np.packbits(2 * ones > count[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return fingerprints


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): 64-bit SimHash of each whole text; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            found = batch_fingerprints(piece.column("text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(run, "id long, fp long")


def triples(positions: int = 8) -> list[tuple[int, int, int]]:
    """Byte positions to index together: every four of the eight positions contain one of these 20 triples (Turan's rule)."""
    part = [i % 3 for i in range(positions)]
    chosen = []
    for t in combinations(range(positions), 3):
        of = sorted(part[i] for i in t)
        a = max(set(of), key=of.count)
        if of.count(a) == 3 or (of.count(a) == 2 and (a + 1) % 3 in of):
            chosen.append(t)
    return chosen


def near(x: np.ndarray, radius: int, matches: int) -> np.ndarray:
    """From the exclusive ors of pairs: tally the bytes they share, keep those with the guaranteed number, and verify."""
    found = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= matches)
    return found[np.bitwise_count(x[found]) <= radius]


def spanning_links(fps: np.ndarray, radius: int, matches: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all of these fingerprints that are linked, at most one for each: a search over those not yet reached."""
    rest = np.arange(len(fps))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            f = frontier.pop()
            hit = near(fps[rest] ^ fps[f], radius, matches)
            if len(hit):
                new = rest[hit]
                yield np.full(len(new), f), new
                frontier.extend(new.tolist())
                rest = np.delete(rest, hit)


def group_links(key: np.ndarray, fps: np.ndarray, radius: int, small: int = 16, large: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of a posting list; rows are sorted by key and the fingerprints of a list are distinct.

    Short lists: all pairs, list by list at once. Longer: spanning links. Very long: posting lists of one more byte position each.
    """
    matches = 8 - radius
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    size = np.diff(cut)
    a, b = [], []
    of = np.repeat(size, size)
    short = np.flatnonzero((of > 1) & (of <= small))
    for d in range(1, small):
        i = short[short + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        hit = i[near(fps[i] ^ fps[i + d], radius, matches)]
        a.append(hit)
        b.append(hit + d)
    for g in np.flatnonzero(size > small):
        rows = np.arange(cut[g], cut[g + 1])
        lists = [rows]
        if len(rows) > large:
            by_byte = fps[rows].view(np.uint8).reshape(-1, 8)
            lists = []
            for p in range(8):
                column = by_byte[:, p]
                if column.min() != column.max():  # else it is a position of the key, or tells nothing
                    order = np.argsort(column, kind="stable")
                    lists += [rows[x] for x in np.split(order, np.flatnonzero(np.diff(column[order])) + 1) if len(x) > 1]
                elif p not in FAMILY[int(key[rows[0]] >> 24)]:
                    lists = [rows]
                    break
        for x in lists:
            for p, q in spanning_links(fps[x], radius, matches):
                a.append(x[p])
                b.append(x[q])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


FAMILY = triples()
#: Rows of the index that a task takes, about.
TASK_ROWS = 4_000_000


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """nodes (node, fp), fingerprints distinct -> (a, b): links that connect what is linked at so many differing bits.

    Two fingerprints within 4 bits share at least 4 of their 8 bytes in place, hence one of 20 triples of bytes. Those
    triples are the keys of the index: the lists are intersections of the lists of single bytes, so their length
    doesn't grow with the number of fingerprints over 256. In each list, shared bytes are tallied and links verified.
    """
    if radius != 4:
        raise ValueError("the index is made for a radius of 4")
    # arithmetic on the fingerprint's bytes: the family's number above three bytes
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.lit(k << 24).cast("long") + byte[p] * 65536 + byte[q] * 256 + byte[r] for k, (p, q, r) in enumerate(FAMILY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int64()), ("node", pa.int64()), ("fp", pa.int64())]))
        key, node, fp = (got.column(c).to_numpy() for c in ("key", "node", "fp"))
        order = np.argsort(key, kind="stable")
        key, node, fp = key[order], node[order], fp[order].view(np.uint64)
        a, b = group_links(key, fp, radius)
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[a[i : i + 100_000]]), pa.array(node[b[i : i + 100_000]])], ["a", "b"])

    index = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp")
    # a partition is held whole: as many as keep each at about TASK_ROWS rows of the index
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * len(FAMILY) // TASK_ROWS))
    return index.repartition(parts, "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp, component): the fingerprint of each document and the least id that it reaches over links of 4 bits or fewer.

    Equal fingerprints are one node of the graph (copies are never paired). Repeated rows give repeated rows. Rows with a
    null id get a fingerprint and, if no other row shares it, a null component. An empty table gives no rows; other columns,
    clashing names too, are left behind. Very long texts are hashed whole. There are no ties but among ids, of which the least counts.
    """
    rows, _ = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes, _ = materialize(rows.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    found = components(links(nodes.filter("node is not null")))
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return rows.join(labels, "fp").select("id", "fp", "component")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
