import zlib

import corpus_pipeline as C
import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenloom.llm import queries, toxicity
from tokenloom.llm.token_files import tokenizer_path

from . import test_decontaminate, test_simhash, test_suffix_dedup

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    made = docs
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r.text for r in made.collect()}
        made = spark.createDataFrame(stage(spark, made, SF).collect(), docs.schema)
        assert made.columns == C.COLUMNS
        after = {r.doc_id: r.text for r in made.collect()}
        if name == "toxicity":
            model = toxicity.trained(spark, SF, docs)
            assert set(after) == {r.id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
            assert len(after) > 0.8 * len(rows)
        elif name.startswith("simhash"):
            ids = sorted(before)
            comp = test_simhash.brute_components(ids, test_simhash.brute([before[i] for i in ids]))
            assert set(after) == set(comp)
        elif name.startswith("suffix"):
            want = {d: x[3].decode(errors="ignore") for d, x in test_suffix_dedup.brute(list(before.items())).items()}
            assert after == {d: t for d, t in want.items() if t or not before[d]}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = test_decontaminate.brute(list(before.items()), items)
            assert set(after) == {d for d, x in hit.items() if not x[1]}
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    used, seen = {}, {}
    for r in C.pack(spark, made, SF).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        ids = [*t.encode(after[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert set(seen) == set(after) and max(used.values()) <= 2048
    assert len(used) <= 1.02 * -(-sum(used.values()) // 2048) + 1


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def edge_docs(spark, kind):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "abc def ghi jkl mno " * 30_000
    rows = {
        "nulls": [(1, None, None, None, None), (None, "some words of a text", "en", "s", 20), (None, None, None, None, None)],
        "empty texts": [(1, "", "en", "s", 0), (2, " ", "en", "s", 1), (3, "words", "en", "s", 5)],
        "very long": [(1, long, "en", "s", len(long)), (2, "short", "en", "s", 5)],
        "ties and repeats": [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (1, "quite another text here", "en", "s", 23), (None, "a b c d e", "en", "s", 9)],
        "empty table": [],
    }
    if kind == "clashing names":
        return spark.createDataFrame([(1, "a b c d", "en", "s", 7, "x", 5)], schema + ", Text string, id int")
    return spark.createDataFrame(rows[kind], schema)


KINDS = ["nulls", "empty texts", "very long", "ties and repeats", "empty table", "clashing names"]


@pytest.mark.parametrize("kind", KINDS)
def test_edges_of_each_stage(spark, kind):
    for name, stage in C.STAGES:
        docs = edge_docs(spark, kind)
        got = stage(spark, docs, SF)
        rows = got.collect()
        if name == "best-fit packing":
            assert sum(r.start == 0 for r in rows) == docs.count()
            continue
        assert got.columns == C.COLUMNS
        texts = sorted((r.doc_id or -1, r.text or "") for r in rows)
        if name.startswith("simhash"):
            want = {
                "nulls": [(-1, "some words of a text"), (1, "")], "empty texts": [(1, ""), (3, "words")], "ties and repeats": [(1, "a b c d e"), (1, "quite another text here")],
            }.get(kind, sorted((r.doc_id or -1, r.text or "") for r in docs.collect()))
            assert texts == want
        elif name.startswith("suffix") and kind == "very long":
            assert texts[1] == (2, "short") and 0 < len(texts[0][1]) < 200
        else:
            assert texts == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
