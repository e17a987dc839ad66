import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenloom.llm import lm_scores


def brute(docs, order, alpha):
    words = [(d, (t or "").lower().split()) for d, t in docs]
    counts = Counter(tuple(w[i : i + n]) for _, w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)
    out = {}
    for d, w in words:
        own = Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        c = lambda g: counts[g] - own[g]  # noqa: E731, B023
        s = 0.0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s += math.log(max(c(g), 1) / max(total - len(w), 1)) + (longest - 1) * math.log(alpha)
                elif c(g) > 0:
                    s += math.log(c(g) / c(g[:-1])) + (longest - n) * math.log(alpha)
                    break
        out[d] = (len(w), s)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("abcdefGH") for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    docs += [(80, None), (81, "  "), (82, "unique words only here"), (83, docs[3][1])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int").repartition(3)
    got = {r.id: (r.n_words, r.log_score) for r in lm_scores.score(df, order=order, block_bytes=500, parts=5).collect()}
    want = brute(docs, order, 0.4)
    assert set(got) == set(want)
    for k, (n, s) in want.items():
        assert got[k][0] == n and abs(got[k][1] - s) < 1e-9 * max(1, abs(s))


def test_rare_words_and_empty(spark):
    assert lm_scores.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a a a b"), (2, "a a c"), (None, "a d"), (2, "a a c")], "doc_id long, text string")
    assert len(lm_scores.score(df).collect()) == 4
    # 70,000 different words, each in two texts: none of them is merged with another
    docs = [(i, " ".join(f"w{j}" for j in range(i // 2 * 1000, i // 2 * 1000 + 1000))) for i in range(140)]
    want = brute(docs, 3, 0.4)
    got = {r.id: (r.n_words, r.log_score) for r in lm_scores.score(spark.createDataFrame(docs, "doc_id long, text string"), parts=7, block_bytes=50_000).collect()}
    assert set(got) == set(want)
    for k, (n, s) in want.items():
        assert got[k][0] == n and abs(got[k][1] - s) < 1e-9 * max(1, abs(s))


def test_words_of_one_hash_count_apart(spark, monkeypatch):
    """Every word has one of three hashes: words are still told apart by their bytes, in a block and in the vocabulary."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefGH") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    batch = pa.record_batch({"id": [d for d, _ in docs], "text": [t for _, t in docs]})
    monkeypatch.setattr(lm_scores, "word_hashes", lambda buf, start, end: ((end - start) % 3).astype(np.uint64))
    names = [w.encode() for _, t in docs for w in t.lower().split()]
    known, words, counts = lm_scores.distinct_words(np.frombuffer(b"".join(names), np.uint8), np.array([len(w) for w in names]))
    assert [known[k].as_py() for k in words.tolist()] == names and counts.tolist() == np.bincount(words).tolist()
    rows = [r for b in lm_scores._ask_words(2)([lm_blocks(batch)]) for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["part"], r["block"]))
    told = [r for b in lm_scores._number_words(2)([pa.RecordBatch.from_pylist(rows, schema=lm_scores.ASKED)]) for r in b.to_pylist()]
    numbers = np.concatenate([lm_scores._unpack(r["numbers"]) for r in told])
    assert len(set(numbers.tolist())) == len(known)


def lm_blocks(batch):
    from unittest import mock

    with mock.patch.object(lm_scores, "TaskContext", mock.Mock(get=lambda: mock.Mock(partitionId=lambda: 0))):
        return next(lm_scores._encode(1 << 20)([batch]))


def test_count_table_is_exact():
    rng = np.random.default_rng(4)
    rows, want = [], Counter()
    for block in range(5):
        grams = np.unique(rng.integers(0, 1 << 32, (40, 3)) * (rng.random((40, 3)) < 0.5), axis=0)
        counts = rng.integers(1, 400, len(grams))
        packed = lm_scores._pack(np.concatenate([np.diff(grams[:, 0], prepend=0), grams[:, 1], grams[:, 2]]))
        rows.append({"n": 3, "grams": packed, "counts": lm_scores._pack_counts(counts)})
        want.update({(block, tuple(g)): c for g, c in zip(grams.tolist(), counts.tolist())})
    total, which, counts, sizes = lm_scores._count_table(rows)
    sums = Counter()
    for (_, g), c in want.items():
        sums[g] += c
    assert total[which].tolist() == [sums[g] for _, g in want] and counts.tolist() == list(want.values()) and sum(sizes) == len(which)


def test_a_very_long_text_and_clashing_names(spark):
    docs = [(0, "x y z " * 40_000), (1, "y z"), (2, None)]
    df = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, Text string")
    got = {r.id: r.log_score for r in lm_scores.score(df, block_bytes=10_000).collect()}
    assert got == pytest.approx({k: s for k, (_, s) in brute(docs, 3, 0.4).items()})
