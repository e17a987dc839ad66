"""Toxicity by nearest labelled examples: exact cosine of TF-IDF, weighted by what tells the labels apart, over block-max inverted lists; votes count by similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, SpanHash, pieces, runs, utf8
from ._spark import carried, carry_columns, materialize, pick, pick_carry
from .decontaminate import WORD

PREFIXES = (4, 5, 6)
BLOCK = 64
FIRST_BLOCKS = 16
#: Cosines held at once by a task.
CELLS = 1 << 19


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and of the first 4, 5 and 6 bytes of longer words; A-Z are lower-cased."""
    buf, off = utf8(column)
    buf = LOWER[buf]
    start, end, first = runs(WORD[buf], off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if not len(start):
        return doc, np.zeros(0, np.uint64)
    spans = SpanHash(buf)
    docs, hashes = [doc], [spans(start, end)]
    for n in PREFIXES:
        some = np.flatnonzero(end - start > n)
        docs.append(doc[some])
        hashes.append(spans(start[some], start[some] + n) ^ np.uint64(n << 32 | 0x5555))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, times) of the vocabulary's terms, by document."""
        doc, h = features(column)
        some = self.maybe[(h >> np.uint64(48)).astype(np.int64)]
        doc, h = doc[some], h[some]
        n = len(self.hashes)
        if not n or not len(h):
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
        real = self.hashes[at] == h
        pair, times = np.unique(doc[real] * n + at[real], return_counts=True)
        return pair // n, pair % n, times


class BlockMaxIndex:
    """Inverted lists of the examples' unit vectors, in blocks of examples with the largest weight of each."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int):
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        self.examples, self.blocks = examples, -(-examples // BLOCK)
        key = term[order] * self.blocks + self.example // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block_start = np.r_[first, len(key)]
        self.block = key[first] % self.blocks if len(key) else first
        self.top = np.maximum.reduceat(self.weight, first) if len(key) else self.weight
        self.term_block = np.searchsorted(key[first] // self.blocks, np.arange(terms + 1)) if len(key) else np.zeros(terms + 1, np.int64)

    def nearest(self, off: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, example, cosine): for documents terms[off[i]:off[i + 1]] the k examples of largest cosine above 0, exactly, best first; ties to the smaller number.

        All documents at once: the blocks of largest bounds are read first, then those whose bound reaches a document's k-th best;
        the others stay unread.
        """
        docs = len(off) - 1
        k = min(k, self.examples)
        lo, n = self.term_block[terms], self.term_block[terms + 1] - self.term_block[terms]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        q, doc = np.repeat(weights, n), np.repeat(np.repeat(np.arange(docs), np.diff(off)), n)
        cell = doc * self.blocks + self.block[entry]
        bound = np.bincount(cell, q * self.top[entry], minlength=docs * self.blocks)
        total = np.zeros(docs * self.examples)

        def read(chosen: np.ndarray) -> np.ndarray:
            mine = chosen[cell]
            e = entry[mine]
            m = self.block_start[e + 1] - self.block_start[e]
            place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.block_start[e], m)
            np.add(total, np.bincount(np.repeat(doc[mine] * self.examples, m) + self.example[place], np.repeat(q[mine], m) * self.weight[place], minlength=len(total)), out=total)
            return np.partition(total.reshape(docs, self.examples), self.examples - k, axis=1)[:, self.examples - k]

        rows = bound.reshape(docs, self.blocks)
        first = min(FIRST_BLOCKS, self.blocks)
        chosen = ((rows >= np.partition(rows, self.blocks - first, axis=1)[:, self.blocks - first, None]) & (rows > 0)).ravel()
        worst = read(chosen)
        more = ~chosen & (bound > 0) & (bound * (1 + 1e-12) >= np.repeat(worst, self.blocks))
        if more.any():
            worst = read(more)
        hit = np.flatnonzero((total >= np.repeat(worst - 1e-11, self.examples)) & (total > 0))
        d, x = hit // self.examples, hit % self.examples
        order = np.lexsort((x, -np.round(total[hit], 12), d))
        d, hit = d[order], hit[order]
        keep = np.arange(len(d)) - np.searchsorted(d, d) < k
        return d[keep], hit[keep] % self.examples, total[hit[keep]]


@dataclass
class Model:
    vocabulary: Vocabulary
    index: BlockMaxIndex | None
    ids: np.ndarray
    label: np.ndarray
    share: np.ndarray  # labelled rows that each example stands for
    prior: float  # of texts with none of the terms
    k: int
    smooth: float = 0.25

    def score(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """Scores, and the examples that voted with their similarities."""
        n = len(column)
        scores, ids, sims = np.full(n, self.prior), [[] for _ in range(n)], [[] for _ in range(n)]
        doc, term, times = self.vocabulary.counts(column)
        if not len(doc):
            return scores, ids, sims
        weight = (1 + np.log(times)) * self.vocabulary.idf[term]
        weight /= np.sqrt(np.bincount(doc, weight * weight, minlength=n))[doc]
        cut = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)]
        mean = float(self.share.mean())
        # a document takes a cell for each example and one for each entry of its terms' lists; one at least goes at a time
        cells = np.add.reduceat(np.diff(self.index.start)[term], cut[:-1]) + self.index.examples
        turn = np.cumsum(cells) // CELLS
        edges = np.r_[np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]), len(cells)]
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            off = cut[a : z + 1]
            at, near, cosine = self.index.nearest(off - off[0], term[off[0] : off[-1]], weight[off[0] : off[-1]], self.k)
            vote, rows = self.share[near] * cosine * cosine, doc[off[:-1]]
            yes, all_ = np.bincount(at, vote * self.label[near], minlength=len(rows)), np.bincount(at, vote, minlength=len(rows))
            scores[rows] = (yes + self.smooth * mean * self.prior) / (all_ + self.smooth * mean)
            edge = np.searchsorted(at, np.arange(len(rows) + 1))
            names, values = self.ids[near].tolist(), cosine.tolist()
            for i, d in enumerate(rows.tolist()):
                ids[d], sims[d] = names[edge[i] : edge[i + 1]], values[edge[i] : edge[i + 1]]
        return scores, ids, sims


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        doc, h = features(piece.column("text"))
        label = piece.column("label").to_numpy()
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        h, y = h[once], label[doc[once]].astype(np.int64)
        term, first = np.unique(h, return_index=True)
        ones = np.add.reduceat(y, first) if len(first) else first
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(ones), pa.array(np.diff(np.r_[first, len(h)]) - ones)], ["term", "ones", "zeros"])


def _document_frequency(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(vocabulary.hashes), np.int64), 0
        for piece in pieces(batches, "text"):
            total += np.bincount(vocabulary.counts(piece.column("text"))[1], minlength=len(total))
            docs += piece.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.r_[total, docs])], ["term", "n"])

    return run


def _vectors(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            doc, term, times = vocabulary.counts(piece.column("text"))
            off = pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("label"), pa.ListArray.from_arrays(off, pa.array(term)), pa.ListArray.from_arrays(off, pa.array(times))], ["id", "label", "term", "times"]
            )

    return run


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_examples: int = 3000, least_z: float = 3.0, k: int = 5,
) -> Model:
    """Learn from labelled documents.

    The examples are a bounded sample: of each label the ``max_examples`` rows of least hash of id (all, if fewer). A term
    weighs its inverse document frequency, which comes from all of ``docs``, times the number z of standard errors by which its
    shares among the two labels differ; there is no cap on terms, and those with z below ``least_z``, by which labels can't be
    told apart, weigh nothing. Null labels don't count, other numbers than 0 count as 1, of
    repeated labels the largest counts; labels without a document are left out, and
    examples with equal texts are one. With one label or none scores are priors.
    """
    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    labels = pick(labels, id=id_col, label=label_col).filter("id is not null and label is not null")
    labels = labels.groupBy(F.col("id").cast("long").alias("id")).agg(F.max((F.col("label") != 0).cast("int")).alias("label"))
    totals = dict(labels.groupBy("label").count().collect())
    order = F.xxhash64("id", F.lit(17))
    chosen = labels.filter("label = 0").orderBy(order, "id").limit(max_examples).union(labels.filter("label = 1").orderBy(order, "id").limit(max_examples))
    # at most 2 * max_examples ids
    sample = docs.join(F.broadcast(chosen), "id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min(F.struct("id", "label")).alias("of"))
    sample, _ = materialize(sample.select("of.id", "of.label", "text"), "examples")
    have = dict(sample.groupBy("label").count().collect())
    n1, n0 = have.get(1, 0), have.get(0, 0)
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    if not n1 or not n0:
        none = np.zeros(0, np.int64)
        return Model(Vocabulary(none.view(np.uint64), np.zeros(0)), None, none, none, np.ones(0), prior, k)
    counts = sample.mapInArrow(_class_counts, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    p = (F.col("a") + F.col("b")) / F.lit(n1 + n0)
    z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(p * (1 - p + 1e-9) * F.lit(1 / n1 + 1 / n0))
    terms = counts.select("term", z.alias("z")).filter(F.col("z") >= least_z).toArrow()  # of the bounded sample
    by = np.argsort(terms.column("term").to_numpy().view(np.uint64))
    vocabulary = Vocabulary(terms.column("term").to_numpy().view(np.uint64)[by])
    df = np.zeros(len(terms) + 1)
    for r in docs.mapInArrow(_document_frequency(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    vocabulary.idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * terms.column("z").to_numpy()[by]
    rows = sorted(sample.mapInArrow(_vectors(vocabulary), "id long, label int, term array<long>, times array<long>").collect())
    ids, label = np.array([r.id for r in rows]), np.array([r.label for r in rows])
    example = np.repeat(np.arange(len(rows)), [len(r.term) for r in rows])
    term = np.array([t for r in rows for t in r.term], np.int64)
    weight = (1 + np.log(np.array([t for r in rows for t in r.times], float))) * vocabulary.idf[term]
    norm = np.sqrt(np.bincount(example, weight * weight, minlength=len(rows)))
    index = BlockMaxIndex(example, term, weight / norm[example], len(rows), len(terms))
    share = np.where(label == 1, totals[1] / n1, totals[0] / n0)
    blank = norm == 0
    prior = ((share * label)[blank].sum() + prior) / (share[blank].sum() + 1)
    return Model(vocabulary, index, ids, label, share, float(prior), k)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, score, evidence, carry if asked for): 0 to 1, and the labelled examples that voted. Needs no shuffle; the model is bounded by its sample.

    Texts with none of the model's terms, null and empty ones too, get the share of such texts that are labelled 1. Texts
    are scored whole, however long; of equal cosines the example of the smaller id votes; repeated rows get equal scores;
    an empty table gives no rows; other columns, clashing names too, are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            scores, ids, sims = model.score(piece.column("text"))
            off = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array([i for x in ids for i in x], pa.int64()), pa.array([s for x in sims for s in x], pa.float64())], ["id", "cosine"])
            more, names = carry_columns(piece)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(scores), pa.ListArray.from_arrays(off, flat), *more], ["id", "score", "evidence", *names])

    docs = pick_carry(docs, carry, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(run, carried(docs, "id long, score double, evidence array<struct<id:bigint,cosine:double>>"))


def fold(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def trained(spark, sf_dir: str, docs: DataFrame | None = None) -> Model:
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", toxic="toxic")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return fit(docs, labels.filter(fold(F.col("doc_id")) != 0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, trained(spark, sf_dir, docs))
    held_out = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
