import random
import zlib

import numpy as np
import pyarrow as pa
from tokenloom.llm import toxicity as T


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        w = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randrange(5, 120))]
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["Scum", "loser", "vejuxx", "vejuyyy", "vejuzé"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    dense = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    dense[100:200] = dense[:100]
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    e, t = np.nonzero(dense)
    index = T.BlockMaxIndex(e, t, dense[e, t], 500, 40)
    queries = []
    for _ in range(60):
        q = rng.random(40) * (rng.random(40) < 0.15)
        if q.any():
            queries.append(q / np.linalg.norm(q))
    for some in (queries, queries[:1]):
        off = np.cumsum([0, *((q > 0).sum() for q in some)])
        doc, example, score = index.nearest(off, np.concatenate([np.flatnonzero(q) for q in some]), np.concatenate([q[q > 0] for q in some]), 10)
        for i, q in enumerate(some):
            cos = dense @ q
            want = [j for j in np.lexsort((np.arange(500), -np.round(cos, 12))) if cos[j] > 0][:10]
            assert example[doc == i].tolist() == want and np.allclose(score[doc == i], cos[want])


def test_blocks_whose_bound_is_too_low_stay_unread(monkeypatch):
    """40 blocks, of which 2 hold the nearest: others would raise if they were read."""
    n = 40 * T.BLOCK
    example, term = np.arange(n), np.zeros(n, np.int64)
    weight = np.where(example < 2 * T.BLOCK, 1.0, 0.1)
    index = T.BlockMaxIndex(example, term, weight, n, 1)
    monkeypatch.setattr(T, "FIRST_BLOCKS", 2)
    index.weight[2 * T.BLOCK :] = np.nan
    _, found, score = index.nearest(np.array([0, 1]), np.array([0]), np.array([1.0]), 15)
    assert found.tolist() == list(range(15)) and (score == 1).all()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "z") for r in rows] + [(9000, None, 0, "z"), (9001, "", 0, "z")], "doc_id long, text string, toxic int, score string")
    labels = docs.select("doc_id", "toxic").filter(T.fold(docs.doc_id) != 0).filter("doc_id < 9000")
    model = T.fit(docs, labels, max_examples=200)
    got = {r.id: r for r in T.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = sum((got[i].score >= 0.5) == bool(y) for i, _, y in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9000].score == got[9001].score < 0.5
    assert any(r.evidence for r in got.values())
    none = T.fit(docs, labels.filter("toxic = 0"))
    assert {round(r.score, 6) for r in T.score(docs, none).collect()} == {round(none.prior, 6)}
    empty = T.fit(docs.limit(0), labels.limit(0))
    assert T.score(docs.limit(0), empty).collect() == []


def test_terms_of_long_and_odd_texts():
    doc, h = T.features(pa.array([None, "", "--", "Abcdefgh ABCDEFGH", "x " * 50_000]))
    assert np.bincount(doc, minlength=5).tolist() == [0, 0, 0, 8, 50_000] and len(set(h[doc == 3])) == 4


def test_held_out_on_generated_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in T.query(spark, sf).collect() if r.doc_id in labels]
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.9
    clean = [r for r in rows if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) / len(clean) < 0.02


def test_calibration_on_held_out_documents(spark):
    """On sf0.1, as sf0.01 has six held-out toxic documents, too few to calibrate on."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in T.query(spark, sf).filter("held_out").collect() if r.doc_id in labels]
    toxic, clean = ([r.predicted for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.005  # some of these labels are noise
    # the mean square error, and in each tenth that has rows enough the means of scores and labels
    assert np.mean([(r.score - labels[r.doc_id]) ** 2 for r in held]) < 0.03
    for t in range(10):
        some = [(r.score, labels[r.doc_id]) for r in held if min(int(r.score * 10), 9) == t]
        if len(some) >= 20:
            assert abs(np.mean([x for x, _ in some]) - np.mean([y for _, y in some])) < 0.2


def brute_scores(docs, labels, k=5, least_z=3.0):
    """Dense vectors of every term and a full scan; only what a term and a hash are is taken from the operator."""
    doc, h = T.features(pa.array([t for _, t in docs]))
    counts = [{} for _ in docs]
    for d, x in zip(doc.tolist(), h.tolist()):
        counts[d][x] = counts[d].get(x, 0) + 1
    place, seen = {d: i for i, (d, _) in enumerate(docs)}, {}
    for d in sorted(labels):
        if docs[place[d]][1] not in seen:
            seen[docs[place[d]][1]] = d
    rows = sorted(seen.values())
    y = np.array([labels[d] for d in rows])
    n1, n0 = y.sum(), (1 - y).sum()
    terms = sorted({x for d in rows for x in counts[place[d]]})
    has = np.array([[x in counts[place[d]] for x in terms] for d in rows], float)
    a, b = has[y == 1].sum(axis=0), has[y == 0].sum(axis=0)
    p = (a + b) / (n1 + n0)
    z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p + 1e-9) * (1 / n1 + 1 / n0))
    terms, z = [x for x, v in zip(terms, z) if v >= least_z], z[z >= least_z]
    df = np.array([sum(x in c for c in counts) for x in terms])
    w = (np.log((len(docs) + 1) / (df + 1)) + 1) * z
    vec = np.array([[(1 + np.log(c[x])) * v if x in c else 0.0 for x, v in zip(terms, w)] for c in counts])
    norm = np.linalg.norm(vec, axis=1)
    unit = vec / np.where(norm > 0, norm, 1)[:, None]
    some = unit[[place[d] for d in rows]]
    total1, total0 = sum(labels.values()), len(labels) - sum(labels.values())
    share = np.where(y == 1, total1 / n1, total0 / n0)
    blank = np.array([norm[place[d]] == 0 for d in rows])
    prior = ((share * y)[blank].sum() + (total1 + 0.5) / (len(labels) + 1)) / (share[blank].sum() + 1)
    out = {}
    for i, (d, _) in enumerate(docs):
        cos = some @ unit[i]
        near = [j for j in np.lexsort((np.arange(len(rows)), -np.round(cos, 12))) if cos[j] > 0][:k]
        vote = share[near] * cos[near] ** 2
        m = 0.25 * share.mean()
        out[d] = ((vote * y[near]).sum() + m * prior) / (vote.sum() + m) if norm[i] else prior
    return out


def test_scores_against_brute_force(spark):
    rows = corpus(250, seed=4)
    rows += [(250, rows[3][1], rows[3][2]), (251, None, 0), (252, "", 0)]
    docs = [(i, t or "") for i, t, _ in rows]
    labels = {i: y for i, _, y in rows[:180]}
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic int, Text string").repartition(3)
    model = T.fit(df, df.select("doc_id", "toxic").filter("doc_id < 180"))
    got = {r.id: r.score for r in T.score(df, model).collect()}
    want = brute_scores(docs, labels)
    assert set(got) == set(want) and all(abs(got[d] - s) < 1e-9 for d, s in want.items())
