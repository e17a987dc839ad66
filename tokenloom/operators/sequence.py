"""All occurrences of many word sequences at once, where the sentences are: a trie of all patterns goes to them.

The cost grows with tokens and with the places at which a pattern begins, not with the number of patterns; nothing is moved
but matches. Patterns that are too many for a worker's memory are joined to the n-grams of their lengths instead. Either plan
is static and works on streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of patterns that go to every worker; with more of them n-grams are joined.
SENT_BYTES = 4 << 20
#: Tokens, and matches, that are looked at or handed over at once.
AT_ONCE = 250_000


def lengths(patterns: DataFrame) -> list[int]:
    """The distinct lengths. Empty patterns are refused: they would match at every place that no pattern reaches."""
    found = sorted(r.n for r in patterns.select(F.size("pattern").alias("n")).distinct().collect())
    if found and found[0] < 1:
        raise ValueError("patterns must not be empty")
    return found


class Trie:
    """Patterns (pattern_index, label, pattern) as arrays: words by number, and each node's children by the number of their word."""

    def __init__(self, patterns: pa.Table):
        self.index, self.label, self.pattern = (patterns.column(c).combine_chunks() for c in ("pattern_index", "label", "pattern"))
        words: dict[str | None, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends = []
        for pattern in self.pattern.to_pylist():
            at = 0
            for w in pattern:
                at = edges.setdefault((at, words.setdefault(w, len(words))), len(edges) + 1)
            ends.append(at)
        self.words = pa.array(list(words), pa.string())
        keys = np.array([node * len(words) + word for node, word in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.by_end = np.argsort(np.array(ends, np.int64), kind="stable")  # patterns by the node they end at
        self.count = np.bincount(np.array(ends, np.int64), minlength=len(edges) + 1)
        self.begin = np.cumsum(self.count) - self.count

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The children by a word each, 0 where there is none."""
        key = node * len(self.words) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((word >= 0) & (self.keys[at] == key), self.children[at], 0)

    def walk(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, nodes): the n words from each place on are a prefix of patterns; ends: of each sentence, one after another."""
        place, node, n = np.arange(len(words)), np.zeros(len(words), np.int64), 0
        while len(self.keys) and len(place):
            node = self.step(node, words[place + n])
            place, node = place[node > 0], node[node > 0]
            n += 1
            if len(place):
                yield n, place, node
            within = ends[np.searchsorted(ends, place, "right")]
            place, node = place[place + n < within], node[place + n < within]

    def matches(self, place: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, patterns) of the patterns that end at a node, in pieces."""
        place, node = place[self.count[node] > 0], node[self.count[node] > 0]
        upto = np.cumsum(self.count[node])
        i = 0
        while i < len(node):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, "right")))
            n = self.count[node[i:j]]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(place[i:j], n), self.by_end[np.repeat(self.begin[node[i:j]], n) + k]
            i = j

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, words) -> (id, pattern_index, start, end, matched_label, pattern)."""
        for batch in batches:
            bounds, values = batch.column(1).offsets.to_numpy().astype(np.int64), batch.column(1).values
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + AT_ONCE, "right")) - 1)
                ids, base, ends = batch.column(0).slice(first, last - first), bounds[first], bounds[first + 1 : last + 1] - bounds[first]
                words = pc.index_in(values.slice(base, bounds[last] - base), value_set=self.words).fill_null(-1).to_numpy()
                starts = bounds[first:last] - base
                for n, place, pattern in self._found(words, ends):
                    sentence = np.searchsorted(ends, place, "right")
                    at = (place - starts[sentence]).astype(np.int32)
                    start, end, of = (at, at + np.int32(n), pattern) if n else (at + np.int32(1), at + np.int32(1), pattern)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(sentence)), self.index.take(pa.array(of)), pa.array(start), pa.array(end), self.label.take(pa.array(of)), self.pattern.take(pa.array(of))],
                        ["id", "pattern_index", "start", "end", "matched_label", "pattern"],
                    )
                first = last

    def _found(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, patterns); n is 0 for the empty pattern, whose place is the token before it."""
        idle = np.ones(len(words), bool)
        for n, place, node in self.walk(words, ends):
            idle[place + n - 1] = False
            for found in self.matches(place, node):
                yield n, *found
        if self.count[0]:
            free = np.flatnonzero(idle)
            for found in self.matches(free, np.zeros(len(free), np.int64)):
                yield 0, *found


def _is_small(patterns: DataFrame) -> bool:
    """Whether patterns can go to every worker: 8 bytes a word and 32 a pattern are what they take besides their text."""
    text = F.aggregate("pattern", F.lit(0).cast("long"), lambda n, w: n + 8 + F.coalesce(F.octet_length(w), F.lit(0)))
    return (patterns.agg(F.sum(text + 32 + F.coalesce(F.octet_length("label"), F.lit(0))).alias("n")).first().n or 0) <= SENT_BYTES


def _by_trie(sentences: DataFrame, patterns: DataFrame, key: str, id_col: str) -> DataFrame:
    trie = Trie(patterns.select("pattern_index", "label", "pattern").filter("pattern is not null").toArrow())
    kinds = [sentences.select(F.col(id_col)).schema[0].dataType, patterns.schema["pattern_index"].dataType, T.IntegerType(), T.IntegerType(), patterns.schema["label"].dataType, patterns.schema["pattern"].dataType]
    names = ("id", "pattern_index", "start", "end", "matched_label", "pattern")
    found = sentences.select(F.col(id_col).alias("id"), F.col(f"tokens.{key}").alias("words")).mapInArrow(trie.find, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))
    return found.withColumnRenamed("id", id_col)


def _grams(sentences: DataFrame, sizes: list[int], key: str, id_col: str) -> DataFrame:
    keys = sentences.select(F.col(id_col), F.col(f"tokens.{key}").alias("_keys"))
    by_size = keys.select(id_col, "_keys", F.explode(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")).alias("_n"))
    places = F.when(F.size("_keys") >= F.col("_n"), F.sequence(F.lit(0), F.size("_keys") - F.col("_n")))
    at = by_size.select(id_col, "_keys", "_n", F.explode(places).alias("start"))
    return at.select(id_col, "start", (F.col("start") + F.col("_n")).alias("end"), F.slice("_keys", F.col("start") + 1, F.col("_n")).alias("_gram"))


def find_all(sentences: DataFrame, patterns: DataFrame, key: str = "text", id_col: str = "sent_id", sizes: list[int] | None = None) -> DataFrame:
    """(id, pattern_index, start, end, matched_label, pattern): 0-based half-open spans, overlaps and repeated patterns included.

    ``key``: text (as written, case counts) or lemma.
    """
    sizes = lengths(patterns) if sizes is None else sizes
    if _is_small(patterns):
        return _by_trie(sentences, patterns.filter(F.size("pattern").isin(sizes)), key, id_col)
    found = _grams(sentences, sizes, key, id_col).join(patterns, F.col("_gram") == F.col("pattern"))
    return found.select(id_col, "pattern_index", "start", "end", F.col("label").alias("matched_label"), "pattern")


def find_all_with_empty(sentences: DataFrame, patterns: DataFrame, key: str = "text", id_col: str = "sent_id") -> DataFrame:
    """find_all() where empty patterns are allowed, as an automaton has them: one occurs, with no length, after each token
    with which no prefix of any other pattern ends, for there the automaton is back at its root.
    """
    if _is_small(patterns):
        return _by_trie(sentences, patterns, key, id_col)
    real = patterns.filter(F.size("pattern") > 0)
    found = find_all(sentences, real, key, id_col)
    prefixes = real.select(F.explode(F.sequence(F.lit(1), F.size("pattern"))).alias("_n"), "pattern").select(F.slice("pattern", 1, F.col("_n")).alias("pattern")).distinct()
    busy = _grams(sentences, lengths(prefixes), key, id_col).join(prefixes, F.col("_gram") == F.col("pattern"), "left_semi").select(id_col, "end").distinct()
    ends = sentences.select(id_col, F.explode(F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens")))).alias("end"))
    rest = ends.join(busy, [id_col, "end"], "left_anti").withColumn("_k", F.lit(0))
    empty = patterns.filter(F.size("pattern") == 0).withColumn("_k", F.lit(0))
    none = rest.join(empty, "_k").select(id_col, "pattern_index", F.col("end").alias("start"), "end", F.col("label").alias("matched_label"), "pattern")
    return found.unionByName(none)


def in_order(matches: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """By sentence, end, longer pattern first, then index."""
    return matches.orderBy(id_col, "end", F.desc(F.size("pattern")), "pattern_index")


def contains(sentences: DataFrame, patterns: DataFrame, key: str = "text", id_col: str = "sent_id") -> DataFrame:
    """The sentences with any match."""
    grams = _grams(sentences, lengths(patterns), key, id_col)
    hit = grams.join(patterns, F.col("_gram") == F.col("pattern"), "left_semi").select(id_col).distinct()
    return sentences.join(hit, id_col, "left_semi")


def pattern_count(patterns: DataFrame) -> int:
    return patterns.count()


def show_match(pattern):
    return F.concat(F.lit("Match { "), F.array_join(pattern, ", "), F.lit(" }"))
