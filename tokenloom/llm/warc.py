"""WARC archives and their index: locally sorted capture runs, merged by a loser tree on URL key and time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, new_path, pick

END = "\r\n\r\n"
#: Upper bounds of the classes of record size; longer ones are the last class.
CLASSES = [1 << k for k in (14, 17, 20, 23, 26)]
RUN = "run long, seq long, urlkey string, captured string, id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, record_offset long, record_length long"
COLUMNS = [c.split()[0] for c in RUN.split(", ")]
RECORD_ID = re.compile(rb"<urn:x-capture:(-?\d+)>")


def record_text(least_revisit: int):
    """The record of a row (id, url, html, digest, size, first): WARC 1.1, response or revisit of an identical payload."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:x-capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    one_line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("urn:x-capture:none")), r"[\x00-\x20\x7F]+", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), header("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    again = F.coalesce((F.col("size") >= least_revisit) & (F.col("id") < F.col("first")), F.lit(False))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    captured = F.date_format(F.timestamp_seconds(F.col("captured")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.concat(
        header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("WARC-Refers-To", urn(F.col("first"))),
        header("WARC-Refers-To-Target-URI", one_line(F.col("first_url"))),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn(F.col("id"))),
        header("WARC-Date", captured),
        header("WARC-Target-URI", one_line(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured=None, least_revisit: int = 1000, file_bytes: int = 32 << 20) -> None:
    """One record for each row, payload the html in UTF-8 (null: empty), in files of at most ``file_bytes``, or one longer record.

    Records are written by classes of size, a folder each, as many to a file as fit if all were the class's longest.

    Of rows with equal payloads of at least ``least_revisit`` bytes, the one with the largest id is a response (each, if
    that id repeats) and the others revisit it. Rows with a null id are responses. ``captured`` gives seconds since 1970;
    without it they are the ids after 2020-01-01. The files are written by Spark's text writer, whose separator is
    the end of a record, so they go to any store. Equal payloads are found by pre-aggregated digests; the pages move
    only if the digests that occur twice are too many to send to all. An empty table gives an empty folder; other columns,
    clashing names too, are left behind.
    """
    pages = pick(pages, id=id_col, url=url_col, html=html_col) if captured is None else pick(pages, id=id_col, url=url_col, html=html_col, captured=captured)
    pages = pages.withColumn("id", F.col("id").cast("long")).withColumn("html", F.coalesce("html", F.lit("")))
    if captured is None:
        pages = pages.withColumn("captured", F.lit(1577836800) + F.coalesce("id", F.lit(0)))
    pages = pages.withColumn("size", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    # headers and what stands between records take less than 1500 bytes, and two addresses of at most three bytes for each
    longest = F.max(F.coalesce(F.octet_length("url"), F.lit(0)))
    room = F.col("size") + 6 * F.coalesce(F.octet_length("url"), F.lit(0)).cast("long") + 1500 + F.lit(3 * (pages.agg(longest).first()[0] or 0))
    groups = pages.filter((F.col("size") >= least_revisit) & F.col("id").isNotNull()).groupBy("digest", "size")
    twice, _ = materialize(
        groups.agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("top")).filter("n > 1").select("digest", "size", F.col("top.id").alias("first"), F.col("top.url").alias("first_url")),
        "twice",
    )
    if not twice.take(1):
        rows = pages.withColumn("first", F.lit(None).cast("long")).withColumn("first_url", F.lit(None).cast("string"))
    else:
        rows = pages.join(twice, ["digest", "size"], "left")
    top = F.lit(len(CLASSES)) - sum((room <= F.lit(c)).cast("int") for c in CLASSES)
    found = {r.k: r.most for r in pages.groupBy(top.alias("k")).agg(F.max(room).alias("most")).collect()}  # a row for each class
    for k, most in (found or {0: 1}).items():
        of_class = rows.filter(top == k).select(record_text(least_revisit).alias("value"))
        of_class.write.option("lineSep", END).option("maxRecordsPerFile", max(1, file_bytes // most)).text(f"{path}/{k}")


def records(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, headers, block) of each record of one file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        block = end + 4
        stop = block + int(headers[b"content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't as long as it says")
        yield at, stop - at, headers, data[block:stop]
        at = stop + 4


def url_key(url: str) -> str:
    """Host labels from the top down, then path and query, in lower case: com,example)/path?query."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return (",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back: one run of captures for each file, sorted by URL key, time and id. A file is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                name = file.as_py()
                for offset, length, headers, block in records(content.as_buffer().to_pybytes()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers[b"warc-type"].decode()
                    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    size, to = int(re.search(rb"(?i)content-length: *(\d+)", head)[1]), None
                    if kind == "response":
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"the payload at byte {offset} of {name} isn't what its digest says")
                    elif m := RECORD_ID.search(headers.get(b"warc-refers-to", b"")):
                        to = int(m[1])
                    own = RECORD_ID.search(headers[b"warc-record-id"])
                    url = headers[b"warc-target-uri"].decode()
                    rows.append((url_key(url), headers[b"warc-date"].decode(), int(own[1]) if own else None, url, size, digest, kind, to, name, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], -(2**63) if r[2] is None else r[2], r[9]))
                yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, (number, i, *r), strict=True)) for i, r in enumerate(rows)], schema=ARROW)
                number += 1

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RUN)


ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in RUN.split(", "))])


def loser_tree(sources: Sequence[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted sources. Inner nodes hold the losers of their matches; after each winner only its path is replayed."""
    k = len(sources)
    if not k:
        return
    head: list[tuple | None] = [next(s, None) for s in sources]
    ahead = lambda a, b: head[b] is None or (head[a] is not None and (head[a], a) <= (head[b], b))
    loser = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, loser[node] = (a, b) if ahead(a, b) else (b, a)
        return win

    winner = play(1) if k > 1 else 0
    while (row := head[winner]) is not None:
        yield row
        head[winner] = next(sources[winner], None)
        node = (winner + k) // 2
        while node:
            if ahead(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).sort_by([("run", "ascending"), ("seq", "ascending")])
    run, key, when = (table.column(c).to_pylist() for c in ("run", "urlkey", "captured"))
    id_ = table.column("id").fill_null(-(2**63)).to_pylist()
    starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
    sources = [zip(key[a:z], when[a:z], id_[a:z], range(a, z)) for a, z in zip(starts, [*starts[1:], len(run)])]  # noqa: B905
    order = [r[3] for r in loser_tree(sources)]
    merged = table.take(pa.array(order, pa.int64())).combine_chunks()
    yield from merged.to_batches(max_chunksize=20_000)


def merge_runs(runs: DataFrame, task_rows: int = 200_000) -> DataFrame:
    """All captures in order of URL key, time and id: each task takes a range of that order from every run and merges the pieces.

    Ranges run over time, id and place as well, so that the captures of one very frequent URL, or even repeats of one
    row, are several tasks' work; there are as many as keep each at about ``task_rows``. Null ids come first; equal
    captures keep the order of their runs. No runs give no rows.
    """
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // task_rows))
    return runs.repartitionByRange(ranges, "urlkey", "captured", "id", "file", "record_offset").mapInArrow(_merge, RUN)


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    runs, _ = materialize(capture_runs(spark, path), "runs")
    history = merge_runs(runs)
    return history.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "captured")
