"""Every operator on nulls, empty and very long texts, ties and repeated rows, empty tables and clashing names."""

import pytest
from tokenloom.llm import decontaminate, html_text, lm_scores, neighbours, packing, simhash, suffix_dedup, token_files, toxicity, warc

LONG = "abc def ghi jkl mno " * 40_000
#: (id, text) rows; pages and labels are made of the same.
ROWS = {
    "nulls": [(1, None), (None, "some words of a text"), (None, None)],
    "empty": [(1, ""), (2, " "), (3, "words")],
    "very long": [(1, LONG), (2, "short")],
    "ties and repeats": [(1, "a b c d e"), (1, "a b c d e"), (1, "quite another text here"), (2, "a b c d e"), (None, "a b c d e"), (None, "a b c d e")],
    "empty table": [],
    "clashing names": [(1, "a b c d"), (2, "e f g h")],
}


def table(spark, kind, id_col="doc_id", text_col="text"):
    rows = ROWS[kind]
    if kind == "clashing names":
        names = f"{id_col} long, {text_col} string, {text_col.upper()} string, {id_col.title()} int, id int, text2 string"
        return spark.createDataFrame([(*r, "x", 5, 6, "y") for r in rows], names).repartition(2)
    return spark.createDataFrame(rows, f"{id_col} long, {text_col} string").repartition(2)


def tokens(spark, docs, path):
    token_files.write_tokens(docs, path, token_files.tokenizer_path(token_files.TOKENIZER))
    return [(r.id, len(r.ids)) for r in token_files.read_tokens(spark, path).collect()]


@pytest.mark.parametrize("kind", list(ROWS))
def test_operators_on_documents(spark, tmp_path, kind):
    docs, rows = table(spark, kind), ROWS[kind]
    ids = sorted(i or -1 for i, _ in rows)
    of = lambda got: sorted(r["id"] if r["id"] is not None else -1 for r in got)
    got = suffix_dedup.dedup(docs).collect()
    assert of(got) == ids and sum(r.n_bytes for r in got) == sum(len(t or "") for _, t in rows)
    if kind == "very long":
        assert [len(r.kept) for r in got if r.id == 1] == [20]  # the period is 20 bytes: strings from byte 20 on start earlier, too
    else:
        assert all(len(r.kept) == r.n_bytes for r in got)
    got = tokens(spark, docs, f"{tmp_path}/t")
    assert sorted(i or -1 for i, _ in got) == ids and all(n >= 1 for _, n in got)
    got = packing.pack_documents(docs, token_files.tokenizer_path(packing.TOKENIZER)).collect()
    assert sorted(r.id or -1 for r in got if r.start == 0) == ids and all(0 <= r.offset <= 2048 - r.length for r in got)
    items = table(spark, kind, "item_id")
    got = decontaminate.contamination(docs, items).collect()
    assert of(got) == ids and all((len(r["items"]) > 0) == (r.n_words > 0) for r in got)
    got = lm_scores.score(docs).collect()
    words = sorted(len((t or "").split()) for _, t in rows)
    assert of(got) == ids and sorted(r.n_words for r in got) == words and all(r.log_score <= 0 for r in got)
    labels = docs.selectExpr("doc_id", "cast(1 as int) as toxic") if kind != "clashing names" else spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, Toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert of(got) == ids and all(0 <= r.score <= 1 for r in got)
    got = simhash.near_duplicates(docs).collect()
    assert of(got) == ids and all((r.fp == 0) == (not (t_ := [t for i, t in rows if i == r.id and (t or "").split()])) for r in got if r.id is not None)


@pytest.mark.parametrize("kind", list(ROWS))
def test_operators_on_pages(spark, tmp_path, kind):
    rows = ROWS[kind]
    pages = table(spark, kind, "page_id", "html")
    pages = pages.selectExpr("*", "concat('http://h/', page_id) as url") if kind != "clashing names" else spark.createDataFrame([(*r, "http://h/x", "u", "H") for r in rows], "page_id long, html string, url string, URL string, Html string")
    got = html_text.extract(pages).collect()
    assert sorted(r.text for r in got) == sorted(" ".join((t or "").split()) for _, t in rows)
    warc.write_warc(pages, f"{tmp_path}/w")
    got = warc.merge_runs(warc.capture_runs(spark, f"{tmp_path}/w")).collect()
    assert sorted((r.id or -1, r.payload_bytes) for r in got) == sorted((i or -1, len(t or "")) for i, t in rows)


@pytest.mark.parametrize("kind", ["nulls", "empty", "very long", "ties and repeats", "empty table", "clashing names"])
def test_neighbours(spark, kind):
    wide = [1.0] * 3000
    rows = {
        "nulls": [(0, None), (None, [1.0, 0.0]), (20, [1.0, None]), (40, [1.0, 1.0]), (3, [1.0, 0.0])], "empty": [(0, []), (20, [])],
        "very long": [(0, wide), (1, wide)], "ties and repeats": [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "empty table": [],
    }
    if kind == "clashing names":
        df = spark.createDataFrame([(0, [1.0, 0.0], 7, [5.0]), (1, [0.5, 0.5], 8, [6.0])], "vec_id long, embedding array<double>, Vec_id long, EMBEDDING array<double>")
    else:
        df = spark.createDataFrame(rows[kind], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in neighbours.nearest_neighbours(df, lambda i: i % 20 == 0).collect())
    assert got == {
        "nulls": [(40, 1, 3)], "empty": [], "very long": [(0, 1, 1)], "empty table": [], "clashing names": [(0, 1, 1)],
        "ties and repeats": [(0, 1, 1), (0, 2, 2)],
    }.get(kind)
