import numpy as np
import pytest
from tokenloom.llm import neighbours as N


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        ok = np.flatnonzero(ids != ids[i])
        best = ok[np.lexsort((ids[ok], -s[ok]))[:k]]
        out[int(ids[i])] = [(int(ids[b]), float(s[b])) for b in best]
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_scores(spark, unit):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50:90] = x[50]  # copies
    df = spark.createDataFrame([(i, v.tolist(), "q") for i, v in enumerate(x)], "vec_id long, embedding array<float>, query string").repartition(4)
    got = {}
    for r in N.nearest_neighbours(df, lambda i: i % 20 == 0, shard_rows=1200).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.id, r.score))
    want = brute(np.arange(3000), x.astype(float), 20)
    assert set(got) == set(want)
    hit = 0
    exact = x.astype(float)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and len({r[1] for r in rows}) == 20
        assert all(abs(s - (exact[q] * exact[i]).sum()) < 1e-12 for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        hit += len({r[1] for r in rows} & {i for i, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.93
    assert [r[1] for r in got[60]] == [i for i, _ in want[60]]


def test_within_finds_every_code():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, (500, 2), dtype=np.uint64)
    codes[:100] = codes[0] ^ (np.uint64(1) << rng.integers(0, 60, (100, 2)).astype(np.uint64))
    index = N.MultiIndex(codes)
    for r in (0, 3, 7, 8, 20, 57, 128):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[5]).sum(axis=1) <= r)
        assert index.within(codes[5], r).tolist() == want.tolist()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (0, [1.0, 0.0]), (20, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in N.nearest_neighbours(df, lambda i: i % 20 == 0, sample_rows=3).collect())
    assert {q for q, *_ in got} == {0} and {i for _, _, i, _ in got} == {5, 8}
    assert N.nearest_neighbours(df.limit(0), lambda i: i % 20 == 0).collect() == []


def ranks(spark, x, **more):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in sorted(tuple(r) for r in N.nearest_neighbours(df, lambda i: i % 20 == 0, **more).collect()):
        got.setdefault(r[0], []).append(r[1:])
    return got


def test_lone_vectors_have_complete_ranks(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(60, 64)))
    x = unit(np.repeat(centres, 40, axis=0) + 0.002 * rng.normal(size=(2400, 64)))
    lone = np.arange(0, 2400, 100)
    x[lone] = unit(rng.normal(size=(len(lone), 64)))
    got, want = ranks(spark, x, shard_rows=900), brute(np.arange(len(x)), x, 20)
    assert set(got) == set(want)
    assert all([r[0] for r in rows] == list(range(1, 21)) for rows in got.values())
    for q in lone.tolist():
        assert [r[1] for r in got[q]] == [i for i, _ in want[q]]


@pytest.mark.parametrize("n", [2, 15, 21, 30])
def test_tables_of_about_k_rows(spark, n):
    got, want = ranks(spark, np.random.default_rng(n).normal(size=(n, 16))), brute(np.arange(n), np.random.default_rng(n).normal(size=(n, 16)), 20)
    assert set(got) == set(want)
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, min(20, n - 1) + 1))
        if n <= 21:
            assert [r[1] for r in rows] == [i for i, _ in want[q]]


def test_scan_is_exact():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 12))
    x[100:200] = x[100]
    ids = rng.permutation(700).astype(np.int64)
    ids[5] = ids[6]
    for (found, score), i in zip(N._scan(ids, x, ids[:150].tolist(), x[:150], 20), range(150), strict=True):
        ok = np.flatnonzero(ids != ids[i])
        s = (x[ok] * x[i]).sum(axis=1)
        best = np.lexsort((ids[ok], -s))[:20]
        assert found.tolist() == ids[ok][best].tolist() and score.tolist() == s[best].tolist()
