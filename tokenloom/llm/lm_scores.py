"""Stupid-backoff scores of whole texts from n-gram counts of the whole corpus, each text's own counts left out.

Relations, all nested by block of documents so that an n-gram costs a few bytes on its way instead of a row:

* blocks (block, documents, words): each document's words as numbers of the block's own dictionary;
* vocabulary: the blocks' distinct words, as text, dealt by hash; gives every word its number in the whole corpus and count;
* grams (part, n, block, words' numbers, counts): the blocks' exploded n-grams, distinct in the block, dealt by hash;
* count tables: each partition sums its grams and joins the sums to them; totals go back to the blocks that asked;
* scores: blocks joined to their totals, summed by document.

Words are told apart as text and n-grams by the numbers of all their words, so different ones never share a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, SpanHash, give_back, mix, pieces, runs, utf8
from ._spark import materialize, materialize_by, pick, remove
from .simhash import SPACE

STEP = np.uint64(0xD6E8FEB86659FD93)
#: n-grams of one order that a task sums at once, about.
TASK_GRAMS = 2_000_000


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as bytes, the lowest bytes of all first, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return _zip(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_unzip(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack_counts(numbers: np.ndarray) -> bytes:
    """Numbers that are small for the most part, and may be any."""
    big = np.flatnonzero(numbers >= 255)
    low = np.minimum(numbers, 255).astype(np.uint8)
    return _zip(np.int64(len(big)).tobytes() + numbers[big].astype("<i8").tobytes() + low.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    raw = _unzip(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out = np.frombuffer(raw, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", n, 8)
    return out


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHash(buf)(start, end)


def distinct_words(inside: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the distinct words, frequent ones first; each word's number among them; their counts), told apart by their bytes."""
    off = pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(size), [None, off, pa.py_buffer(inside)]).dictionary_encode()
    at = coded.indices.to_numpy()
    times = np.bincount(at, minlength=len(coded.dictionary))
    by = np.argsort(-times, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return coded.dictionary.take(pa.array(by)), rank[at], times[by]


def _encode(block_bytes: int):
    """Blocks of documents: a block's distinct words, frequent ones first, and each word's number among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "text", block_bytes):
            buf, off = utf8(piece.column("text"))
            buf = LOWER[buf]
            inside = ~SPACE[buf]
            start, end, first = runs(inside, off)
            known, words, counts = distinct_words(buf[inside], end - start)
            ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("id"))
            lengths = pa.array([np.diff(first).tolist()], pa.list_(pa.int64()))
            packed = [pa.array([x], pa.binary()) for x in (_zip(b" ".join(known.to_pylist())), _pack_counts(counts), _pack(words))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(words)], pa.int64()), ids, lengths, *packed], ["block", "size", "ids", "lengths", "known", "counts", "words"])
            number += 1

    return run


BLOCK = "block long, size long, ids array<long>, lengths array<long>, known binary, counts binary, words binary"


def _known(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """A block's words and their hashes."""
    text = _unzip(data)
    buf = np.frombuffer(text, np.uint8)
    if not len(buf):
        return pa.array([], pa.binary()), np.zeros(0, np.uint64)
    cut = np.flatnonzero(buf == 0x20)
    start, end = np.r_[0, cut + 1], np.r_[cut, len(buf)]
    inside = np.delete(buf, cut)
    off = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(inside)]), word_hashes(buf, start, end)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    give_back()


def _by_part(part: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by part and then; the parts that occur; where each begins)."""
    order = np.lexsort((*then[::-1], part))
    edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else np.zeros(0, np.int64)
    return order, part[order][edge], np.r_[edge, len(part)]


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, h = _known(row["known"])
            counts = _unpack_counts(row["counts"])
            order, which, edge = _by_part((h % np.uint64(parts)).astype(np.int64))
            rows = [
                {"part": int(p), "block": row["block"], "words": _zip(b" ".join(words.take(pa.array(order[a:z])).to_pylist())), "counts": _pack_counts(counts[order[a:z]])}
                for p, a, z in zip(which, edge[:-1], edge[1:], strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=ASKED)

    return run


ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
TOLD = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("numbers", pa.binary()), ("elsewhere", pa.binary())])


def _groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[list[dict]]:
    """Rows come sorted by key; lists of those with equal ones."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and any(held[0][k] != row[k] for k in key):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _number_words(parts: int):
    """One partition of the vocabulary: numbers by falling count, and how often each word stands in other blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "part"):
            words = [_known(r["words"])[0] for r in rows]
            coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
            at, counts = coded.indices.to_numpy().astype(np.int64), np.concatenate([_unpack_counts(r["counts"]) for r in rows])
            total = np.bincount(at, counts, minlength=len(coded.dictionary)).astype(np.int64)
            by = pc.sort_indices(pa.table({"n": -total, "w": coded.dictionary}), [("n", "ascending"), ("w", "ascending")]).to_numpy()
            number = np.empty(len(by), np.int64)
            number[by] = rows[0]["part"] + parts * np.arange(len(by))
            if len(by) and number.max() >= 1 << 32:
                raise ValueError("over 2^32 numbers of words")
            done = 0
            for r, w in zip(rows, words, strict=True):
                s = slice(done, done + len(w))
                done += len(w)
                out = {"part": r["part"], "block": r["block"], "numbers": _pack(number[at[s]]), "elsewhere": _pack_counts(total[at[s]] - counts[s])}
                yield pa.RecordBatch.from_pylist([out], schema=TOLD)

    return run


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their words' numbers in the corpus and counts in other blocks, in place of the words' text."""
    for row in _rows(batches):
        h = _known(row["known"])[1]
        numbers, elsewhere = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        order, which, edge = _by_part((h % np.uint64(row["parts"])).astype(np.int64))
        told = {t["part"]: t for t in row["told"] or []}
        for p, a, z in zip(which.tolist(), edge[:-1], edge[1:], strict=True):
            numbers[order[a:z]], elsewhere[order[a:z]] = _unpack(told[p]["numbers"]), _unpack_counts(told[p]["elsewhere"])
        out = {k: row[k] for k in ("block", "ids", "lengths", "words")} | {"numbers": _pack(numbers), "elsewhere": _pack_counts(elsewhere)}
        yield pa.RecordBatch.from_pylist([out], schema=NUMBERED_ARROW)


NUMBERED = "block long, ids array<long>, lengths array<long>, words binary, numbers binary, elsewhere binary"
NUMBERED_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("numbers", pa.binary()), ("elsewhere", pa.binary())])


def _places(lengths: np.ndarray) -> np.ndarray:
    """Each word's place in its own text."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Gram:
    """The distinct n-grams of a block's texts: which of them ends at each place (-1: none) and which ones are shared.

    ``count`` is how often the block holds each, ``own`` how often the text at each place does. Shared ones consist of words
    that other blocks hold, too; the others can't occur elsewhere. ``columns`` are the numbers of the shared ones' words.
    """

    def __init__(self, n: int, key: np.ndarray, place: np.ndarray, doc: np.ndarray, words: np.ndarray, numbers: np.ndarray, shared: np.ndarray):
        self.n, size = n, len(words)
        order = np.argsort(key, kind="stable")  # places of an n-gram stay in order, so those of a text are together
        k, d = key[order], doc[place[order]]
        fresh = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        edge = np.flatnonzero(fresh)
        self.count = np.diff(np.r_[edge, len(k)])
        self.which = np.full(size, -1, np.int64)
        self.which[place[order]] = np.cumsum(fresh) - 1
        edge_own = np.flatnonzero(fresh | np.r_[True, d[1:] != d[:-1]]) if len(k) else edge
        times = np.diff(np.r_[edge_own, len(k)])
        self.own = np.zeros(size, np.int64)
        self.own[place[order]] = np.repeat(times, times)
        last = place[order[edge]]
        some = np.ones(len(last), bool)
        for j in range(n):
            some &= shared[words[last - j]]
        self.shared = np.flatnonzero(some)
        self.columns = [numbers[words[last[self.shared] - j]] for j in range(n - 1, -1, -1)]

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shared n-grams by partition and first word."""
        h = np.zeros(len(self.shared), np.uint64)
        for c in self.columns:
            h = mix(h * STEP + c.astype(np.uint64))
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort((part << 32) | self.columns[0])
        edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else order
        return order, part[order][edge], np.r_[edge, len(part)]


def _grams(words: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, elsewhere: np.ndarray, order: int) -> Iterator[Gram]:
    """n-grams from 2 words up, inside a text; exact, as the rank of the first words goes into the next key."""
    at, size, doc = _places(lengths), max(1, len(numbers)), np.repeat(np.arange(len(lengths)), lengths)
    shared, rank = elsewhere > 0, words
    for n in range(2, order + 1):
        place = np.flatnonzero(at >= n - 1)
        g = Gram(n, rank[place - 1] * size + words[place], place, doc, words, numbers, shared)
        rank = g.which
        yield g


def _block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _unpack(row["words"]), np.array(row["lengths"], np.int64), _unpack(row["numbers"]), _unpack_counts(row["elsewhere"])


def _send(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for g in _grams(*_block(row), order):
                by, which, edge = g.dealt(parts)
                rows = []
                for p, a, z in zip(which.tolist(), edge[:-1], edge[1:], strict=True):
                    first, *more = (c[by[a:z]] for c in g.columns)
                    grams = _pack(np.concatenate([np.diff(first, prepend=0), *more]))  # sorted by the first word
                    rows.append({"part": p, "n": g.n, "block": row["block"], "grams": grams, "counts": _pack_counts(g.count[g.shared[by[a:z]]])})
                yield pa.RecordBatch.from_pylist(rows, schema=SENT_ARROW)

    return run


SENT = "part int, n int, block long, grams binary, counts binary"
SENT_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
ANSWER = "part int, n int, block long, elsewhere binary"
ANSWER_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("elsewhere", pa.binary())])


def _count_table(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """One partition of one order's table: (total of each distinct n-gram, which one each row sent is, its count, rows' sizes)."""
    n = rows[0]["n"]
    columns: list[list[np.ndarray]] = [[] for _ in range(n)]
    for r in rows:
        sent = _unpack(r["grams"]).reshape(n, -1)
        for k in range(n):
            columns[k].append((np.cumsum(sent[0]) if k == 0 else sent[k]).astype(np.uint32))
    sizes = [len(c) for c in columns[0]]
    which = np.concatenate(columns[0])
    for k in range(1, n):  # exact: the rank of the first words, then the next word's number
        key = which.astype(np.uint64) << np.uint64(32)
        key |= np.concatenate(columns[k])
        columns[k] = []
        order = np.argsort(key)
        key = key[order]
        which = np.empty(len(key), np.uint32)
        which[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=np.uint32) if len(key) else 0
    counts = np.concatenate([_unpack_counts(r["counts"]) for r in rows])
    return np.bincount(which, counts).astype(np.int64), which, counts, sizes


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count table's join: for each n-gram that a block sent, how often the other blocks hold it, in the block's order."""
    for rows in _groups(batches, "part", "n"):
        total, which, counts, sizes = _count_table(rows)
        elsewhere = total[which] - counts
        done = 0
        for r, size in zip(rows, sizes, strict=True):
            yield pa.RecordBatch.from_pylist([{"part": r["part"], "n": r["n"], "block": r["block"], "elsewhere": _pack_counts(elsewhere[done : done + size])}], schema=ANSWER_ARROW)
            done += size


def _score(corpus_words: int, order: int, alpha: float):
    def one(row) -> tuple[np.ndarray, np.ndarray]:
        words, lengths, numbers, elsewhere = _block(row)
        doc, at = np.repeat(np.arange(len(lengths)), lengths), _places(lengths)
        answers = {(a["n"], a["part"]): a["elsewhere"] for a in row["answers"] or []}
        # counts in all other documents, of n-grams that end at each place
        single = Gram(1, words, np.arange(len(words)), doc, words, numbers, elsewhere > 0)
        count = elsewhere[words] + single.count[single.which] - single.own
        every = np.maximum(corpus_words - lengths, 1)[doc]
        best = np.log(np.maximum(count, 1)) - np.log(every) + np.log(alpha) * np.minimum(order - 1, at)
        for g in _grams(words, lengths, numbers, elsewhere, order):
            by, which, edge = g.dealt(row["parts"])
            total = g.count
            for p, a, z in zip(which.tolist(), edge[:-1], edge[1:], strict=True):
                total[g.shared[by[a:z]]] += _unpack_counts(answers[g.n, p])
            place = np.flatnonzero(g.which >= 0)
            lower, count = count, np.zeros(len(words), np.int64)
            count[place] = total[g.which[place]] - g.own[place]
            place = np.flatnonzero(count > 0)
            spare = np.minimum(order - 1, at[place]) - (g.n - 1)  # alpha for each word of context that goes unused
            best[place] = np.log(count[place]) - np.log(lower[place - 1]) + np.log(alpha) * spare
        return lengths, np.bincount(doc, best, minlength=len(lengths)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths, score = one(row)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(lengths), pa.array(score)], ["id", "n_words", "log_score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, block_bytes: int = 4 << 20, parts: int | None = None) -> DataFrame:
    """(id, n_words, log_score): sum over a text's words of the natural log of their stupid-backoff score.

    Words are what stands between ASCII white space, A-Z lower-cased; every word and n-gram counts, however rare, and the
    tables grow with the corpus. The driver learns one number, how many words there are; from it come the partitions of the
    tables, so that none sums more than about ``TASK_GRAMS`` n-grams of an order at once (``parts`` sets them). A word's score is
    c(n-gram) / c(context) for its longest n-gram of at most ``order`` words with c > 0, times ``alpha`` for each shorter
    step; for a single word c / N with c at least 1. Counts are of all documents, less those of the text itself.

    Null, empty and wordless texts have 0 words and score 0; repeated rows and rows with null ids are documents of their own;
    an empty table gives no rows; other columns, clashing names too, are left behind. There are no ties to break.
    """
    if order < 2:
        raise ValueError("n-grams of at least 2 words")
    spark = docs.sparkSession
    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    texts, texts_path = materialize(docs.mapInArrow(_encode(block_bytes), BLOCK), "blocks")
    total = texts.agg(F.sum("size")).first()[0] or 0
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_GRAMS))
    asked = texts.select("block", "known", "counts").mapInArrow(_ask_words(parts), "part int, block long, words binary, counts binary")
    told = asked.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_number_words(parts), "part int, block long, numbers binary, elsewhere binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("part", "numbers", "elsewhere")).alias("told"))
    named = texts.drop("size", "counts").join(told, "block", "left").withColumn("parts", F.lit(parts))
    blocks, _ = materialize_by(named.mapInArrow(_renumber, NUMBERED), "numbered", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    remove(spark, texts_path)
    sent = blocks.drop("ids").mapInArrow(_send(order, parts), SENT).repartition(parts, "part").sortWithinPartitions("part", "n", "block")
    answers = sent.mapInArrow(_answer, ANSWER).groupBy("block").agg(F.collect_list(F.struct("part", "n", "elsewhere")).alias("answers"))
    joined = blocks.join(answers, "block", "left").withColumn("parts", F.lit(parts))
    return joined.mapInArrow(_score(total, order, alpha), "id long, n_words long, log_score double")


def query(spark, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "log_score", mean.alias("mean_log_score"))
