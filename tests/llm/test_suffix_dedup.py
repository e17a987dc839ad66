import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from tokenloom.llm import suffix_dedup as S
from tokenloom.llm.deepshallow import deep_shallow


def brute(docs, width=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            else:
                seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), int(gone.sum()), spans, kept)
    return out


def documents():
    rng = random.Random(8)
    syl = ["the", "an", "é", "tion", " ", " ", ". ", "漢", "x"]
    make = lambda n: "".join(rng.choice(syl) for _ in range(n))
    passage = [make(90) for _ in range(4)]
    base = [make(rng.choice([10, 60, 300])) for _ in range(25)]
    docs = []
    for i in range(110):
        t = rng.choice(base) if i % 3 else make(200)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice([make(1), rng.choice(passage)]) + t[k + rng.randrange(3) :]
        docs.append(t)
    docs += ["a" * 700, "a" * 99, "a" * 100, "ab" * 300, None, "", "\x00" * 130, "q" + "\x00" * 130, docs[0], docs[0], make(9000), passage[0] * 30]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("piece", [2 << 20, 3000])
def test_against_brute_force(spark, piece, monkeypatch):
    docs = documents()
    want = brute(docs)
    monkeypatch.setattr(S.repeated_spans, "__defaults__", (100, piece))
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, spans int").repartition(5)
    got = {r.id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in S.dedup(df).collect()}
    assert got == want


@pytest.mark.parametrize("shallow", [8, 16, 48])
def test_deep_shallow_sorts(shallow):
    rng = np.random.default_rng(shallow)
    rows = np.repeat(rng.integers(0, 3, (60, 48)), 6, axis=0).astype(np.uint8)
    rows[np.arange(len(rows)), rng.integers(0, 48, len(rows))] = rng.integers(0, 4, len(rows))
    order, lcp = deep_shallow(rows, shallow)
    strings = [rows[i].tobytes() for i in order]
    assert strings == sorted(strings) and sorted(order.tolist()) == list(range(len(rows)))
    for i in range(1, len(rows)):
        a, b = strings[i - 1], strings[i]
        assert lcp[i] == next((k for k in range(48) if a[k] != b[k]), 48)


def test_empty_null_ids_and_repeated_rows(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(3, t), (3, t), (5, t), (None, "zz")], "doc_id long, text string")
    got = sorted(((r.id is None, r.id or 0), len(r.kept)) for r in S.dedup(df).collect())
    assert got == [((False, 3), len(t)), ((False, 3), len(t)), ((False, 5), 0), ((True, 0), 2)]


def test_rows_that_share_an_id_are_cut_by_their_own_spans(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, texts = make(300), [make(400) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1] + shared), (7, texts[2] + shared + texts[3]), (7, shared + texts[4]), (7, texts[4]), (9, shared), (9, shared), (9, texts[5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, TEXT string").repartition(3)
    got = sorted(((r.id is None, r.id or 0), r.carry.text, bytes(r.kept).decode()) for r in S.dedup(df, carry=["text"]).collect())
    tie = dict(spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect())
    order = sorted({(-1 if i is None else i, tie[t]) for i, t in rows})
    place = {k: n for n, k in enumerate(order)}
    want = brute([(n, next(t for i, t in rows if (-1 if i is None else i, tie[t]) == k)) for k, n in place.items()])
    assert got == sorted(((i is None, i or 0), t, want[place[-1 if i is None else i, tie[t]]][3].decode()) for i, t in rows)


def test_frequent_grams_and_large_groups_are_split(spark, monkeypatch):
    """One passage in most documents, with other surroundings in each, and equal ones in some: no group is sorted whole."""
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, ends = make(60), [make(70) for _ in range(5)]
    docs = [(i, make(rng.randrange(80)) + rng.choice(ends) + line + rng.choice(ends) + make(rng.randrange(80))) for i in range(400)]
    docs += [(400 + i, docs[i][1]) for i in range(50)] + [(500, None)]
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(S, "GROUP_ROWS", 20)
    monkeypatch.setattr(S, "COUNTERS", 64)
    got = {r.id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in S.dedup(df).collect()}
    assert got == want


def test_halves_keep_every_pair_of_equal_strings():
    """Rows of one group, halved down to single starts, give the spans that the whole group gives."""
    rng = np.random.default_rng(2)
    width, n = 100, 60
    core = rng.integers(97, 100, S.GRAM).astype(np.uint8)
    sides = [rng.integers(97, 100, 76).astype(np.uint8) for _ in range(3)]
    rows = []
    for i in range(n):
        left, right = sides[rng.integers(3)][: rng.integers(77)], sides[rng.integers(3)][: rng.integers(77)]
        left = left[::-1]  # what stands nearest the anchor is shared
        rows.append({"key": 1, "doc": i, "place": 1000, "before": len(left), "bytes": bytes(left) + bytes(core) + bytes(right), "r0": 0, "r1": width - S.GRAM + 1})
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("bytes", pa.binary()), ("r0", pa.int64()), ("r1", pa.int64())])

    def cover(batches):
        out = set()
        for b in batches:
            for r in b.to_pylist():
                out |= {(r["doc"], x) for x in range(r["lo"], r["hi"])}
        return out

    whole = pa.RecordBatch.from_pylist(rows, schema=schema)
    want = cover(S._compare_strings(width)([whole]))
    level = [whole]
    for _ in range(7):
        halved = [b for b in S._halves(width)(level) if b.num_rows]
        table = pa.Table.from_batches(halved).sort_by("key")
        groups = [g for _, g in table.to_pandas().groupby("key")]
        got = set()
        for g in groups:
            got |= cover(S._compare_strings(width)([pa.RecordBatch.from_pandas(g, schema=schema, preserve_index=False)]))
        single = table.filter(pa.compute.equal(pa.compute.subtract(table["r1"], table["r0"]), 1)).to_pandas()
        for _, g in single.groupby("key"):
            strings = {b[k - r : k - r + width] for b, k, r in zip(g["bytes"], g["before"], g["r0"])}
            assert len(strings) == 1
        assert got == want
        level = table.to_batches()


def test_query_digest(spark, tmp_path):
    t = "".join(chr(97 + i * i % 23) + str(i) for i in range(100))
    spark.createDataFrame([(1, t), (2, t + "!!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.query(spark, str(tmp_path)).collect()}
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (len(t), 1, hashlib.sha256(b"!!").hexdigest())
