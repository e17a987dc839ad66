import hashlib
import random

import pytest
from tokenloom.llm import warc


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randrange(50), rng.randrange(3)) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.loser_tree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def pages():
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(i, f"http://www.A{i % 3}.example.com/x{i % 2}?q={i}", big if i % 4 == 0 else f"<p>{i}\r\n\r\nWARC/1.1\r\n</p>" * i) for i in range(40)]
    return [*rows, (40, None, None), (41, "no url\r\nX: y", ""), (42, "http://b/", "s" * 999), (43, "http://b/", "s" * 999), (44, "http://[bad", "t" * 1000), (45, "http://b/", "t" * 1000), (45, "http://b/", "t" * 1000), (46, "http://long/", "漢" * 100_000)]


@pytest.mark.parametrize("file_bytes", [32 << 20, 20_000])
def test_round_trip(spark, tmp_path, file_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    warc.write_warc(df, f"{tmp_path}/w", file_bytes=file_bytes)
    sizes = [(f.stat().st_size, f.read_bytes().count(b"WARC/1.1\r\nWARC-Type")) for f in (tmp_path / "w").glob("*/*.txt")]
    assert sizes and all(n == 1 or size <= file_bytes for size, n in sizes)
    runs = warc.capture_runs(spark, f"{tmp_path}/w")
    got = warc.merge_runs(runs).collect()
    order = [(r.urlkey, r.captured, r.id) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h] = max(best.get(h, -1), i)
    text = {i: h for i, _, h in rows}
    for r in got:
        p = (text[r.id] or "").encode()
        again = len(p) >= 1000 and best[text[r.id]] != r.id
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", best[text[r.id]]) if again else ("response", None))


def test_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.merge_runs(warc.capture_runs(spark, f"{tmp_path}/w")).collect() == []


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("http://m.x.org:8080") == "org,x,m:8080)/"
    assert warc.url_key("not a url") == "not a url"


def test_one_url_and_repeated_rows_take_several_ranges(spark, tmp_path):
    rows = [(i // 2, "http://one/", f"p{i // 2}") for i in range(600)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"{tmp_path}/w")
    merged = warc.merge_runs(warc.capture_runs(spark, f"{tmp_path}/w"), task_rows=50)
    assert merged.rdd.getNumPartitions() == 12
    assert [r.id for r in merged.collect()] == [i // 2 for i in range(600)]
    assert max(merged.rdd.glom().map(len).collect()) < 200


def test_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x", "y"), (2, "http://b/", None, "z")], "page_id long, url string, html string, HTML string")
    warc.write_warc(df, f"{tmp_path}/w")
    assert [r.payload_bytes for r in warc.merge_runs(warc.capture_runs(spark, f"{tmp_path}/w")).collect()] == [1, 0]
