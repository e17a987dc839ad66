"""Benchmark decontamination: an FM-index for each training shard, searched backwards for every benchmark window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, SpanHash, pieces, runs, utf8
from ._spark import carried, carry_columns, materialize, pick, pick_carry

#: Bytes of words: digits, lower-case letters and all that isn't ASCII.
WORD = np.ones(256, bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
BLOCK_BYTES = 8 << 20
#: Blocks sent with one scan of the documents.
SCAN_BLOCKS = 8


def distinct(sequence: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number from 0 up, without gaps, for each run of words, equal for equal runs: the rank of the first words with the next one, word by word."""
    code, done = np.zeros(len(begin), np.int64), 0
    size = int(sequence.max(initial=0)) + 1
    for k in range(int(length.max(initial=0))):
        go = length > k
        code[go] = np.unique(code[go] * size + sequence[begin[go] + k], return_inverse=True)[1]
    out = np.empty(len(begin), np.int64)
    for n in np.unique(length).tolist():  # runs of another length are others
        some = length == n
        out[some] = code[some] + done
        done += int(code[some].max()) + 1
    return np.unique(out, return_inverse=True)[1]


class Phrases:
    """The distinct windows of one block of benchmark items, as places in the items' words; words have numbers from 1 up.

    All of it is a few arrays, together about four times the block's text.
    """

    def __init__(self, items: list[str], texts: pa.Array, window: int):
        buf, off = utf8(texts)
        buf = LOWER[buf]
        inside = WORD[buf]
        start, end, first = runs(inside, off)
        offsets = pa.py_buffer(np.r_[0, np.cumsum(end - start)].astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(buf[inside])]).dictionary_encode()
        self.words = [b"", *coded.dictionary.to_pylist()]
        self.sequence = coded.indices.to_numpy().astype(np.int32) + 1
        words = np.diff(first)
        n = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
        begin = np.arange(int(n.sum())) + np.repeat(first[:-1] - np.cumsum(n) + n, n)
        length = np.repeat(np.minimum(words, window), n)
        self.items, item = np.unique(np.array(items, object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        same = distinct(self.sequence, begin, length)
        kept = np.unique(same, return_index=True)[1]
        self.start, self.length = begin[kept].astype(np.int32), length[kept].astype(np.int32)
        pair = np.unique(same * max(1, len(self.items)) + np.repeat(item, n))  # each distinct window's items
        self.item_start = np.searchsorted(pair // max(1, len(self.items)), np.arange(len(kept) + 1))
        self.item = (pair % max(1, len(self.items))).astype(np.int32)
        joined = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        hashes = SpanHash(joined)(np.r_[0, ends[:-1]], ends)[1:] if len(self.words) > 1 else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order + 1
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def word(self, which: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th word of each of these windows."""
        return self.sequence[self.start[which] + k].astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words of no window."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            out[some] = np.where(self.hashes[at] == hashes[some], self.number[at], 0)
        return out


class WaveletMatrix:
    """Ranks of any symbol in a sequence: for each bit, the zeros before each place, with the sequence dealt by that bit."""

    def __init__(self, seq: np.ndarray, largest: int):
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            one = (seq >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((bit, zeros))
            seq = np.concatenate([seq[one == 0], seq[one == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low = np.zeros(len(place), np.int64)
        for bit, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            n0 = zeros[-1]
            low = np.where(one, n0 + low - zeros[low], zeros[low])
            place = np.where(one, n0 + place - zeros[place], zeros[place])
        return place - low


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Of words with 0 as separators; each separator counts as a symbol of its own, ordered by place, below all words."""
    n = len(seq)
    stop = seq == 0
    rank = np.where(stop, np.cumsum(stop) - 1, seq + int(stop.sum()))
    rank = np.unique(rank, return_inverse=True)[1]
    h = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        if rank[order[-1]] == n - 1:
            return order
        h *= 2


class FMIndex:
    """Backward search and location in one shard's words."""

    def __init__(self, seq: np.ndarray, largest: int, step: int = 8):
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1] if self.n else seq
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=largest + 1))])
        self.ranks = WaveletMatrix(self.bwt, largest)
        sampled = (sa % step == 0) | (self.bwt == 0)  # a walk back never has to cross a separator
        self.position = np.where(sampled, sa, -1)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.ranks.rank(symbol, place)

    def search(self, word: Callable[[np.ndarray, np.ndarray], np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase; ``word`` gives the k-th words of phrases."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for k in range(1, int(length.max(initial=0)) + 1):
            go = np.flatnonzero((length >= k) & (low < high))
            if not len(go):
                break
            symbol = word(go, length[go] - k)
            low[go], high[go] = self.step(symbol, low[go]), self.step(symbol, high[go])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start: walk back to the nearest sampled one."""
        out, walked = np.empty(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            known = self.position[row] >= 0
            out[todo[known]] = self.position[row[known]] + walked
            todo, row, walked = todo[~known], row[~known], walked + 1
            row = self.step(self.bwt[row], row)
        return out


def shard_hits(phrases: Phrases, buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, hashes: np.ndarray):
    """(word, length, phrase) of every occurrence of a window in one shard's words, which have these bounds and hashes."""
    none = np.zeros(0, np.int64)
    if not len(start) or not len(phrases.length):
        return none, none, none
    number = phrases.numbers(hashes)
    # Only runs of benchmark words as long as the shortest window can hold one; all others stay out of the index.
    a, b, _ = runs(number > 0, first)
    long = b - a >= phrases.length.min()
    a, b = a[long], b[long]
    if not len(a):
        return none, none, none
    size = b - a + 1
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    seq = number[np.minimum(place, len(number) - 1)]
    seq[np.cumsum(size) - 1] = 0
    index = FMIndex(seq, len(phrases.words) - 1)
    low, high = index.search(phrases.word, phrases.length)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    word = place[index.locate(row)]
    # Word numbers came from 64-bit hashes; hold the words found against the windows' words.
    length = phrases.length[which].astype(np.int64)
    held = np.unique(np.repeat(word, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))
    data = buf.tobytes()
    wrong = [w for w in held.tolist() if data[start[w] : end[w]] != phrases.words[number[w]]]
    if wrong:
        bad = np.zeros(len(start) + 1, np.int64)
        bad[np.array(wrong) + 1] = 1
        bad = np.cumsum(bad)
        good = bad[word + length] == bad[word]
        word, length, which = word[good], length[good], which[good]
    return word, length, which


def _scan(blocks: Sequence[Broadcast], shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        starts: list[int] = []
        for block in blocks:
            starts.append(len(names))
            names += block.value.items.tolist()
        all_names, width = pa.array([*names, ""], pa.string()), len(names) + 1
        for piece in pieces(batches, "text", shard_bytes):
            buf, off = utf8(piece.column("text"))
            buf = LOWER[buf]
            start, end, first = runs(WORD[buf], off)
            hashes = SpanHash(buf)(start, end) if len(start) else np.zeros(0, np.uint64)
            docs = piece.num_rows
            cover = np.zeros(len(start) + 1, np.int64)
            pairs = [np.zeros(0, np.int64)]
            for block, at in zip(blocks, starts, strict=True):
                word, length, which = shard_hits(block.value, buf, start, end, first, hashes)
                np.add.at(cover, word, 1)
                np.add.at(cover, word + length, -1)
                once = np.unique((np.searchsorted(first, word, "right") - 1) * max(1, len(block.value.start)) + which)
                of, which = once // max(1, len(block.value.start)), once % max(1, len(block.value.start))
                n = block.value.item_start[which + 1] - block.value.item_start[which]
                item = block.value.item[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.value.item_start[which], n)]
                pairs.append(np.unique(np.repeat(of, n) * width + item + at))
            hit = np.cumsum(cover)[:-1] > 0
            a, b, span_first = runs(hit, first)
            pair = np.concatenate(pairs)
            doc = pair // width
            item = all_names.take(pa.array(pair % width)).to_pylist()
            order = sorted(range(len(pair)), key=lambda i: (doc[i], item[i]))
            order = [i for k, i in enumerate(order) if not k or (doc[i], item[i]) != (doc[order[k - 1]], item[order[k - 1]])]
            item_off = np.searchsorted(doc[order], np.arange(docs + 1))
            base = off[np.searchsorted(first, a, "right") - 1]
            doc_first = first[np.searchsorted(first, a, "right") - 1]
            spans = pa.StructArray.from_arrays(
                [pa.array(x) for x in (a - doc_first, b - doc_first, start[a] - base, end[b - 1] - base)],
                ["word_start", "word_end", "byte_start", "byte_end"],
            )
            more, names_more = carry_columns(piece)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(span_first.astype(np.int32)), spans),
                    pa.ListArray.from_arrays(pa.array(item_off.astype(np.int32)), pa.array([item[i] for i in order], pa.string())),
                    *more,
                ],
                ["id", "n_words", "spans", "items", *names_more],
            )

    return run


SPANS = "array<struct<word_start:bigint,word_end:bigint,byte_start:bigint,byte_end:bigint>>"
SCHEMA = f"id long, n_words long, spans {SPANS}, items array<string>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = BLOCK_BYTES,
    scan_blocks: int = SCAN_BLOCKS, carry: Sequence[str] = (),
) -> DataFrame:
    """(id, n_words, spans, items, carry if asked for): merged spans of words, and bytes, inside any occurrence of a window of the benchmark.

    No shuffle: each task indexes its shards of whole documents and searches them for the windows it was sent. These are
    broadcast in blocks of at most ``block_bytes`` of benchmark text (one item at least), ``scan_blocks`` of them with each scan
    of the documents. With more blocks than that the rows are numbered, written once, scanned several times, and the spans of
    each row merged by its number. Null and wordless texts have no words, null or wordless items no windows; items
    are named by their ids as text (null: empty), and items that share an id are one. Each row gives a row, whatever its
    id, repeated rows too; shards end between documents, so a very long text is one shard. Empty tables are fine on either
    side; other columns, clashing names too, are left behind. There are no ties to break.
    """
    docs = pick_carry(docs, carry, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    items = pick(benchmark, item=item_col, text=item_text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
    items = items.filter("text is not null").withColumn("size", F.octet_length("text").cast("long"))
    total = items.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n > scan_blocks:
        numbered, _ = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        docs = numbered.select(F.col("row").alias("id"), "text")
    context, found, sent = docs.sparkSession.sparkContext, [], []
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = block.select("item", "text").toArrow()
        sent.append(context.broadcast(Phrases(rows.column("item").to_pylist(), rows.column("text").combine_chunks(), window)))
        if len(sent) == scan_blocks or k == n - 1:
            found.append(docs.mapInArrow(_scan(sent, shard_bytes), carried(docs, SCHEMA)))
            sent = []
    if len(found) == 1:
        return found[0]
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    merged = union.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    join = (
        "aggregate(spans, cast(array() as " + SPANS + "), (a, s) -> if(size(a) > 0 and s.word_start <= a[size(a) - 1].word_end, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('word_start', a[size(a) - 1].word_start, 'word_end', greatest(a[size(a) - 1].word_end, s.word_end), "
        "'byte_start', a[size(a) - 1].byte_start, 'byte_end', greatest(a[size(a) - 1].byte_end, s.byte_end)))), concat(a, array(s))))"
    )
    merged = merged.withColumnRenamed("id", "row").withColumn("spans", F.expr(join))
    return numbered.drop("text").join(merged, "row").select("id", "n_words", "spans", "items", *(["carry"] if carry else []))


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.word_end - s.word_start)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
