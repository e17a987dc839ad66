import hashlib
import random
import re

import numpy as np
from tokenloom.llm import decontaminate as D


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for p, who in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= who
        out[d] = (len(w), len(hit), sorted(found))
    return out


def data():
    rng = random.Random(2)
    voc = ["The", "cat", "été", "x1", "of", "7", "漢字"]
    items = [(i, ", ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 3, 9, 10, 14])) if True)) for i in range(30)]
    items += [(30, None), (31, "a b c d e f g h i j k l"), (31, "zz yy xx")]
    docs = []
    for d in range(60):
        w = [rng.choice([*voc, "q", "r"]) for _ in range(rng.randrange(0, 120))]
        if d % 4 == 0:
            w += "A B c d e f g h i j k l".split()
        docs.append((d, " ".join(w)))
    return [*docs, (60, None), (61, ""), (62, "--"), (63, "the cat " * 4000)], items


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs, items = data()
    items = [x for x in items if len(words(x[1])) != 1]
    want = brute(docs, items)
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, items string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    for extra in ({}, {"block_bytes": 200}, {"block_bytes": 200, "scan_blocks": 2}, {"shard_bytes": 100}):
        got = {r.id: r for r in D.contamination(d, b, **extra).collect()}
        assert {k: (r.n_words, sum(s.word_end - s.word_start for s in r.spans), r["items"]) for k, r in got.items()} == want
    text = dict(docs)
    for k, r in got.items():
        for s in r.spans:
            cut = (text[k] or "").encode()[s.byte_start : s.byte_end].decode()
            assert words(cut) == words(text[k])[s.word_start : s.word_end]


def test_index_against_plain_search():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 4, 400)
    seq[-1] = 0
    index = D.FMIndex(seq, 3)
    for _ in range(200):
        p = rng.integers(1, 4, int(rng.integers(1, 6)))
        want = [i for i in range(len(seq)) if seq[i : i + len(p)].tolist() == p.tolist()]
        low, high = index.search(lambda which, k: p[k], np.array([len(p)]))
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:2] for r in D.contamination(docs, items.limit(0)).collect()] == [(1, 2)]
    assert D.contamination(docs.limit(0), items).collect() == []
    assert D.contamination(docs, items).first()["items"] == ["1"]


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "a b"), (9, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in D.query(spark, str(tmp_path)).collect()}
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and got[1].contaminated and got[1].n_hit == 2
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].contaminated


def test_many_blocks_keep_rows_that_share_an_id(spark):
    docs = [(1, "a b"), (1, "x a b c d"), (1, "clean"), (None, "c d"), (None, "clean, too"), (None, None), (2, "a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(7, "a b"), (8, "c d"), (9, "e f")], "item_id long, text string")
    key = lambda r: (r.id, r.carry.text, r.n_words, [tuple(s) for s in r.spans], r["items"])
    got = [sorted(map(key, D.contamination(df, items, carry=["text"], block_bytes=size, scan_blocks=scan).collect()), key=repr) for size, scan in ((1 << 20, 8), (3, 1), (3, 9))]
    spans = {r[1]: [s[:2] for s in r[3]] for r in got[1]}
    assert len(got[1]) == len(docs) and spans["x a b c d"] == [(1, 5)] and spans["clean"] == spans["clean, too"] == []
    assert got[0] == got[1] == got[2]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "z")], "doc_id long, text string, Text string")
    items = spark.createDataFrame([(7, "a b", "z")], "item_id long, text string, TEXT string")
    r = D.contamination(df, items, carry=["doc_id", "text"]).first()
    assert (r.id, r.n_words, r["items"], tuple(r.carry)) == (1, 3, ["7"], (1, "a b c"))
