import random
import re
from itertools import combinations

import numpy as np
import xxhash
from tokenloom.llm import simhash
from tokenloom.llm.components import components


def brute(texts):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "ÉTÉ", "x", "漢字", "d'un", " nb"]
    made = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    for t in made[:20]:
        w = t.split(" ")
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "edit"
            made.append("\n".join(v))
    return [*made, None, "", "  \t", "one", "one two three", made[0], made[0], "the end " * 3000]


def test_every_four_positions_hold_a_triple():
    assert len(simhash.FAMILY) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.FAMILY)


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    want = brute([t for _, t in rows])
    comp = brute_components([i for i, _ in rows], want)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component string").repartition(5)
    got = {r.id: r for r in simhash.near_duplicates(df).collect()}
    assert [got[i].fp & (2**64 - 1) for i, _ in rows] == want
    assert [got[i].component for i, _ in rows] == comp


def test_links_of_random_and_dense_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in fps[:5]:
        fps += [x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(60)]
    fps = sorted({x & (2**63 - 1) for x in fps})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "node long, fp long")
    got = dict(components(simhash.links(df)).collect())
    want = brute_components(list(range(len(fps))), fps)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_long_posting_lists_are_split():
    rng = np.random.default_rng(4)
    low = rng.permutation(2**16)[:3000].astype(np.uint64) * np.uint64(2**40)
    fps = np.unique(low | np.uint64(0x030201))
    a, b = simhash.group_links(np.zeros(len(fps), np.int64), fps, 4, large=500)
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in zip(a, b))
    want = brute_components(list(range(400)), [int(x) for x in fps[:400]])
    i, j = simhash.group_links(np.zeros(400, np.int64), fps[:400], 4, large=100)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert [find(x) for x in range(400)] == want


def test_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (7, None)], "doc_id long, text string")
    got = sorted((r.id is None, r.id, r.component) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 7, 7), (True, None, 7)]
