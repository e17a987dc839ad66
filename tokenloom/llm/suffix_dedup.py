"""Removal of every byte in a 100-byte string that starts earlier, too, by sorting suffixes at content-chosen places.

A full suffix array of 100 TB would move each byte many times. Equal strings of 100 bytes choose equal anchors inside them
(the place of the least hash of any 24 bytes), so it is enough to sort what stands around anchors: about one suffix in
39. Anchors whose 24 bytes occur once drop out before any text is moved; where the whole surroundings are equal (by two
hashes of 64 bits, of the 24 bytes and of all), one stands for all; the rest are sorted, to the right and to the left, by
deep-shallow sorting, and the common prefixes of neighbours in both orders tell which strings are equal.

No task gets an unbounded group: 24 bytes so frequent that they would fill a task are dealt by their surroundings, and
groups too large to be sorted at once are split by longer common strings until they aren't.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SpanHash, give_back, mix, pieces, table, utf8
from ._spark import carried, carry_columns, materialize, pick_carry, spread
from .deepshallow import deep_shallow

GRAM = 24
#: Surroundings of one group that are sorted at once; larger groups are split.
GROUP_ROWS = 50_000
#: Counters for each partition, by which frequent grams are found.
COUNTERS = 16


def anchors(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, skip: int = 0, most: int | None = None):
    """Of texts buf[lo:hi]: each anchor's place, the text it is in, and the hash of its gram.

    Strings are those whose start, from their text's, is at least ``skip`` and less than ``most``.
    """
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < width:
        return none, none, none.view(np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    h, size = table(11)[buf], 1
    for grow in (1, 2, 4, 8, 8):  # spans of 2, 4, 8, 16, 24 bytes
        right = h if grow == size else part
        h = h[: n - size - grow + 1] * np.uint64(pow(base, grow, 2**64)) + right[size : size + n - size - grow + 1]
        if grow == 4:
            part = h
        size += grow
    gram = mix(h)
    # the hash's upper half, then the place: the least is the leftmost of the least
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    window, have = width - GRAM + 1, 1
    while have < window:
        d = min(have, window - have)
        least = np.minimum(least[:-d], least[d:])
        have += d
    ok = np.zeros(n + 1, np.int8)  # starts of strings inside one text
    a, b = lo + skip, hi - width + 1
    if most is not None:
        b = np.minimum(b, lo + most)
    some = a < b
    np.add.at(ok, a[some], 1)
    np.add.at(ok, b[some], -1)
    chosen = (least[np.cumsum(ok[: len(least)]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = np.unique(chosen) if len(chosen) else none
    return place, np.searchsorted(hi, place, "right"), gram[place]


def _surroundings(sums: SpanHash, place, lo, hi, width: int):
    left = np.minimum(place - lo, width - GRAM)
    right = np.minimum(hi - place, width)
    return left, right, sums(place - left, place + right) ^ mix((left * 1024 + right).astype(np.uint64))


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Union of half-open spans of each document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    fresh = np.r_[True, doc[1:] != doc[:-1]]
    number = np.cumsum(fresh)
    top = int(b.max()) + 1
    reach = np.maximum.accumulate(b + number * top) - number * top
    start = fresh | (a > np.r_[0, reach[:-1]])
    first = np.flatnonzero(start)
    return doc[first], a[first], reach[np.r_[first[1:], len(doc)] - 1]


def _pack(place, left, right):
    return (place << 16) | (left << 8) | right


def _checked(size: np.ndarray) -> np.ndarray:
    if size.max(initial=0) > 0xFFFFFF:
        raise ValueError("a piece has more than 16 MB")
    return size


def _first_of_equals(key, around, doc, packed):
    """Order by (key, around, doc, place); True for rows that stand before all others of equal surroundings, or at their place."""
    order = np.lexsort((packed, doc, around, key))
    key, around, doc, packed = key[order], around[order], doc[order], packed[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (around[1:] != around[:-1])] if len(key) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return order, fresh, (doc == doc[head]) & (packed == packed[head])


def _pieces_of(batches: Iterator[pa.RecordBatch], width: int, piece_bytes: int):
    """(doc, first byte's place, bytes, lo, hi, skip, most) of pieces of texts; a very long one in several, with margins for surroundings."""
    for piece in pieces(batches, "text", piece_bytes):
        buf, off = utf8(piece.column("text"))
        doc = piece.column("doc").to_numpy(zero_copy_only=False)
        if len(buf) <= 2 * piece_bytes:
            yield doc, 0, buf, off[:-1], off[1:], 0, None
            continue
        for s in range(0, len(buf), piece_bytes):
            a, b = max(0, s - width), min(len(buf), s + piece_bytes + 3 * width)
            yield doc, a, buf[a:b], np.array([0]), np.array([b - a]), s - a, s - a + piece_bytes


def _count_grams(width: int, piece_bytes: int, counters: int):
    """How many anchors fall on each counter, a gram always on the same one; one row for each counter and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for _, _, buf, lo, hi, skip, most in _pieces_of(batches, width, piece_bytes):
            place, text, gram = anchors(buf, lo, hi, width, skip, most)
            if not len(place):
                continue
            around = _surroundings(SpanHash(buf), place, lo[text], hi[text], width)[2]
            total += np.bincount(np.mod(_distinct(gram, around).view(np.int64), counters), minlength=counters)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])

    return run


def _distinct(gram: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The grams of distinct (gram, surroundings)."""
    order = np.argsort(mix(gram) ^ around)
    g, w = gram[order], around[order]
    return g[np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]]


def _find_anchors(width: int, piece_bytes: int):
    """Rows (key, around, doc, packed) of anchors, equal surroundings once for each piece; spans of the others (around is null)."""

    def rows(doc, base, buf, lo, hi, skip=0, most=None):
        place, text, gram = anchors(buf, lo, hi, width, skip, most)
        left, right, around = _surroundings(SpanHash(buf), place, lo[text], hi[text], width) if len(place) else (place, place, gram)
        where = place - lo[text] + base
        key, around = gram.view(np.int64), around.view(np.int64)
        packed, doc = _pack(where, left, right), doc[text]
        order, fresh, first = _first_of_equals(key, around, doc, packed)
        again = order[~first]
        gone, a, b = _merged(doc[again], where[again] - left[again], where[again] + right[again])
        keep = order[fresh]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, around, doc, packed)], NAMES)
        if len(gone):
            any_key = mix(gone.view(np.uint64) + a.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(any_key), pa.nulls(len(gone), pa.int64()), pa.array(gone), pa.array((a << 24) | _checked(b - a))], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces_of(batches, width, piece_bytes):
            yield from rows(*piece)

    return run


NAMES = ["key", "around", "doc", "packed"]


def _compare_anchors(counters: int, frequent: np.ndarray):
    """One partition's anchors, all of equal surroundings: spans to remove (key is null), and anchors whose surroundings have to be compared.

    Of grams that aren't on a frequent counter all anchors are here, so those with one kind of surroundings are done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=pa.schema([(c, pa.int64()) for c in NAMES]))
        is_span = got.column("around").is_null()
        spans, got = got.filter(is_span), got.filter(pa.compute.invert(is_span))
        packed = spans.column("packed").to_numpy()
        out = [(None, spans.column("doc").to_numpy(), packed >> 24, (packed >> 24) + (packed & 0xFFFFFF))]
        key, around, doc, packed = (got.column(c).to_numpy() for c in NAMES)
        dealt = np.isin(np.mod(key, counters), frequent)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False] | dealt[order]] if len(order) else order
        key, around, doc, packed, dealt = key[order], around[order], doc[order], packed[order], dealt[order]
        order, fresh, first = _first_of_equals(key, around, doc, packed)
        again = order[~first]
        place, left, right = packed >> 16, (packed >> 8) & 255, packed & 255
        out.append((None, doc[again], place[again] - left[again], place[again] + right[again]))
        head = order[fresh]  # one for each surroundings
        same = key[head][1:] == key[head][:-1]
        head = head[np.r_[False, same] | np.r_[same, False] | dealt[head]] if len(head) else head
        out.append((key[head], doc[head], place[head], place[head]))
        for k, d, a, b in out:
            for i in range(0, len(d), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d[s]), pa.int64()) if k is None else pa.array(k[s]), pa.array(d[s]), pa.array(a[s]), pa.array(b[s])], ["key", "doc", "lo", "hi"])
        del got, spans, out, key, around, doc, packed, dealt, order, head, place, left, right
        give_back()

    return run


def _cut_out(width: int):
    """Each wanted anchor's bytes: up to width - GRAM before it and width from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            buf, off = utf8(piece.column("text"))
            wanted = piece.column("wanted")
            count = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            key, at = flat.field(0), flat.field(1).to_numpy()
            text = np.repeat(np.arange(piece.num_rows), count)
            doc = piece.column("doc").to_numpy(zero_copy_only=False)[text]
            place = at + off[text]
            inside = place + GRAM <= off[text + 1]  # false only where rows share an id and differ in text
            left = np.minimum(at, width - GRAM)
            right = np.minimum(off[text + 1] - place, width)
            for i in range(0, len(place), 20_000):
                s = np.flatnonzero(inside[i : i + 20_000]) + i
                lo, hi = place[s] - left[s], place[s] + right[s]
                size = hi - lo
                take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                cut = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(buf[take])])
                yield pa.RecordBatch.from_arrays([key.take(pa.array(s)), pa.array(doc[s]), pa.array(at[s]), pa.array(left[s]), cut], ["key", "doc", "place", "before", "bytes"])

    return run


def _halves(width: int):
    """Rows of groups that are too large, once for each half of the places where strings may start.

    All strings that start r0 to r1 - 1 bytes before the anchor hold the r0 bytes before it and the width - r1 + 1 from it on: these
    name the new group. At a single start the group's strings are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column("bytes"))
            key, before, r0, r1 = (batch.column(c).to_numpy() for c in ("key", "before", "r0", "r1"))
            middle, after = off[:-1] + before, np.diff(off) - before
            sums, cut = SpanHash(buf, 31), (r0 + r1 + 1) // 2
            for a, b in ((r0, cut), (cut, r1)):
                need = width - b + 1
                some = np.flatnonzero((b > a) & (before >= a) & (after >= need))
                named = mix(sums(middle[some] - a[some], middle[some] + need[some]) ^ mix(key[some].view(np.uint64) + (a[some] * 512 + b[some]).astype(np.uint64)))
                kept = batch.take(pa.array(some))
                columns = [pa.array(named.view(np.int64)), *(kept.column(c) for c in ("doc", "place", "before", "bytes")), pa.array(a[some]), pa.array(b[some])]
                yield pa.RecordBatch.from_arrays(columns, [*CUT, "r0", "r1"])

    return run


CUT = ["key", "doc", "place", "before", "bytes"]
CUT_SCHEMA = "key long, doc long, place long, before long, bytes binary, r0 long, r1 long"


def _split_large(rows: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """Spans in groups of over GROUP_ROWS rows; ``keys`` (key) names these among the rows' groups."""
    found = None
    while True:
        large, _ = materialize(rows.join(keys, "key", "left_semi").select(*CUT, "r0", "r1").mapInArrow(_halves(width), CUT_SCHEMA), "large")
        # at a single start the strings of a group are equal: all but the first go, and the first is found without gathering them
        last = large.filter("r1 - r0 = 1")
        first = last.groupBy("key").agg(F.min(F.struct("doc", "place")).alias("first"))
        others = last.select("key", "doc", "place", "r0").join(first, "key").filter("doc <> first.doc or place <> first.place")
        spans = others.select("doc", (F.col("place") - F.col("r0")).alias("lo"), (F.col("place") - F.col("r0") + width).alias("hi"))
        open_ = large.filter("r1 - r0 > 1")
        sizes = open_.groupBy("key").agg(F.count("*").alias("n"))
        keys, _ = materialize(sizes.filter(F.col("n") > GROUP_ROWS).select("key"), "large-keys")
        small = open_.join(keys, "key", "left_anti").select(*CUT, "r0", "r1")
        spans = spans.union(spread(small, "key").sortWithinPartitions("key").mapInArrow(_compare_strings(width), "doc long, lo long, hi long"))
        found = spans if found is None else found.union(spans)
        if keys.isEmpty():
            return found
        rows = open_


def _classes(lcp: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its class of equal prefixes of this depth."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def equal_strings(right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, doc, place, width: int, r0: np.ndarray | None = None, r1: np.ndarray | None = None):
    """For each anchor the least and largest number of bytes before it at which an earlier equal string starts (-1: none).

    With r0 and r1 only strings that start at least r0 and less than r1 bytes before the anchor count. Rows come in order of (doc, place). ``right`` holds the bytes from the anchor on, ``left`` those before it, reversed.
    """
    n = len(right)
    r_order, r_lcp = deep_shallow(right, 2 * GRAM)
    l_order, l_lcp = deep_shallow(left, GRAM)
    least, most = np.full(n, -1), np.full(n, -1)
    for r in range(width - GRAM + 1):
        here = (n_left >= r) & (n_right >= width - r)
        ok = np.flatnonzero(here if r0 is None else here & (r0 <= r) & (r < r1))
        if len(ok) < 2:
            continue
        pair = _classes(l_lcp, l_order, r)[ok] * (n + 1) + _classes(r_lcp, r_order, width - r)[ok]
        order = np.argsort(pair, kind="stable")
        fresh = np.r_[True, pair[order][1:] != pair[order][:-1]]
        head = ok[order[np.maximum.accumulate(np.where(fresh, np.arange(len(ok)), 0))]]
        row = ok[order]
        hit = row[(doc[row] != doc[head]) | (place[row] != place[head])]
        most[hit] = r
        least[hit] = np.where(least[hit] < 0, r, least[hit])
    return least, most


def _compare_strings(width: int):
    def solve(got: pa.Table) -> pa.RecordBatch:
        doc, place, before, r0, r1 = (got.column(c).to_numpy() for c in ("doc", "place", "before", "r0", "r1"))
        order = np.lexsort((place, doc))
        doc, place, before, r0, r1 = doc[order], place[order], before[order], r0[order], r1[order]
        buf, off = utf8(got.column("bytes").combine_chunks().take(pa.array(order)))
        pad = np.r_[buf, np.zeros(2 * width, np.uint8)]
        after = np.diff(off) - before
        col = np.arange(-(-width // 8) * 8)
        middle = off[:-1] + before
        right = np.where(col < after[:, None], pad[middle[:, None] + col], 0).astype(np.uint8)
        left = np.where(col < before[:, None], pad[middle[:, None] - 1 - np.minimum(col, before[:, None])], 0).astype(np.uint8)
        ranges = (r0, r1) if (r1 - r0 <= width - GRAM).any() else ()
        least, most = equal_strings(right, after, left, before, doc, place, width, *ranges)
        hit = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(place[hit] - most[hit]), pa.array(place[hit] - least[hit] + width)], ["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by key; keys stay whole
            while batch.num_rows:
                key = batch.column("key").to_numpy()
                if rows >= GROUP_ROWS:
                    cut = int(np.searchsorted(key, held[-1].column("key")[-1].as_py(), "right"))
                    if cut:
                        held.append(batch.slice(0, cut))
                        batch = batch.slice(cut)
                    if batch.num_rows:
                        yield solve(pa.Table.from_batches(held))
                        held, rows = [], 0
                    continue
                cut = min(batch.num_rows, GROUP_ROWS - rows)
                held.append(batch.slice(0, cut))
                rows += cut
                batch = batch.slice(cut)
        if held:
            yield solve(pa.Table.from_batches(held))
            held = []
        give_back()

    return run


def repeated_spans(docs: DataFrame, width: int = 100, piece_bytes: int = 1 << 20) -> DataFrame:
    """docs (doc, text) -> (doc, lo, hi): spans of bytes, overlapping ones too, whose union is what starts earlier as well."""
    if not GRAM + 8 <= width <= 255:
        raise ValueError("strings of 32 to 255 bytes")
    spark = docs.sparkSession
    long = docs.filter(F.octet_length("text") >= width)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counters = COUNTERS * parts
    counts = long.mapInArrow(_count_grams(width, piece_bytes, counters), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    n = counts.column("n").to_numpy()
    # a counter with more anchors than two tasks' share holds a gram that would fill a task; there are fewer than partitions
    frequent = counts.column("counter").to_numpy()[n > max(2 * n.sum() / parts, 1)] if len(n) else np.zeros(0, np.int64)
    found = long.mapInArrow(_find_anchors(width, piece_bytes), "key long, around long, doc long, packed long")
    deal = F.col("key") if not len(frequent) else F.when(F.pmod("key", F.lit(counters)).isin(frequent.tolist()), F.xxhash64("key", "around")).otherwise(F.col("key"))
    compared, _ = materialize(spread(found, deal).mapInArrow(_compare_anchors(counters, frequent), "key long, doc long, lo long, hi long"), "anchors")
    spans = compared.filter("key is null").select("doc", "lo", "hi")
    heads = compared.filter("key is not null")
    sizes = heads.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS)
    large, _ = materialize(sizes.select("key"), "large-keys")
    has_large = not large.isEmpty()

    def cut(heads: DataFrame) -> DataFrame:
        wanted = heads.groupBy("doc").agg(F.collect_list(F.struct("key", F.col("lo").alias("place"))).alias("wanted"))
        rows = docs.join(wanted, "doc").mapInArrow(_cut_out(width), "key long, doc long, place long, before long, bytes binary")
        return rows.withColumns({"r0": F.lit(0).cast("long"), "r1": F.lit(width - GRAM + 1).cast("long")})

    small = heads.join(large, "key", "left_anti") if has_large else heads
    more = spread(cut(small), "key").sortWithinPartitions("key").mapInArrow(_compare_strings(width), "doc long, lo long, hi long")
    spans = spans.union(more)
    return spans.union(_split_large(cut(heads.join(large, "key", "left_semi")), large, width)) if has_large else spans


def _apply(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield _cut(piece, as_text)

    return run


def _cut(piece: pa.RecordBatch, as_text: bool) -> pa.RecordBatch:
    buf, off = utf8(piece.column("text"))
    spans = piece.column("spans")
    count = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    text = np.repeat(np.arange(piece.num_rows), count)
    size = np.diff(off)
    a, b = (np.minimum(flat.field(i).to_numpy(), size[text]) for i in (0, 1))
    text, a, b = _merged(text, a, b)
    real = b > a
    text, a, b = text[real], a[real], b[real]
    gone = np.zeros(len(buf) + 1, np.int64)
    np.add.at(gone, a + off[text], 1)
    np.add.at(gone, b + off[text], -1)
    keep = np.cumsum(gone[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[off]
    data = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(buf[keep])])
    first = np.searchsorted(text, np.arange(piece.num_rows + 1))
    merged = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["lo", "hi"]))
    if as_text:
        data = pa.array([b.decode(errors="ignore") for b in data.to_pylist()], pa.string())
    more, names = carry_columns(piece)
    return pa.RecordBatch.from_arrays([piece.column("id"), pa.array(size), merged, data, *more], ["id", "n_bytes", "spans", "kept", *names])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, as_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(id, n_bytes, spans array<struct<lo, hi>>, kept binary, carry if asked for): what is left of each whole text once repeats are cut out.

    A byte goes if a string of ``width`` bytes around it also starts earlier: in a row of a smaller id, or earlier in the
    same row; strings are judged on the input. Null texts are empty; shorter texts stay whole, very long ones go in pieces. Ids
    are 64-bit and null ones count as the smallest. Rows that share an id (null ones, too) rank by a hash of their text, and
    each is cut by its own spans; equal rows rank equal, so neither is cut for the other's sake. An empty table gives no rows;
    other columns, clashing names too, are left behind.
    ``kept`` may begin or end inside a character of several bytes; ``as_text`` makes it a string without such parts.
    """
    docs = pick_carry(docs, carry, id=id_col, text=text_col).withColumns({"id": F.col("id").cast("long"), "text": F.coalesce("text", F.lit(""))})
    docs = ranked(docs)
    spans = repeated_spans(docs.select("doc", "text"), width).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    joined = docs.join(spans, "doc", "left").withColumn("spans", F.coalesce("spans", empty))
    kind = "string" if as_text else "binary"
    return joined.mapInArrow(_apply(as_text), carried(docs, f"id long, n_bytes long, spans array<struct<lo:bigint,hi:bigint>>, kept {kind}"))


def ranked(docs: DataFrame) -> DataFrame:
    """docs (id, text, ...) with ``doc``: a number for each document, in order of id and, for rows that share one, a hash of their text.

    It is the id itself where no two different texts share one, null ids none at all. Else rows are numbered by counts of
    ranges, as ids leave no room between them.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    texts = docs.groupBy("id", tie.alias("tie")).agg(F.lit(1).alias("one"))
    shared = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1)
    if shared.isEmpty():
        return docs.withColumn("doc", F.col("id"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.select("id", "tie").repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie").withColumn("at", F.monotonically_increasing_id())
    placed, _ = materialize(placed, "ranks")
    # monotonic numbers rise with the ranges, so they are ranks as they are
    other = placed.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("at").alias("doc"))
    return docs.join(other, F.col("id").eqNullSafe(F.col("_id")) & (tie == F.col("_tie"))).drop("_id", "_tie")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
