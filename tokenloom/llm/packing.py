"""Best-fit packing by hierarchical residuals: partitions pack alone, nearly full bins leave, the others meet again as items."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import pieces
from ._spark import materialize, pick
from .encoding import encoder, with_end
from .token_files import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
PIECE = "struct<id:bigint,piece:int,start:bigint,length:bigint,crc:bigint>"
BIN = f"done boolean, used int, members array<{PIECE}>"
OUT = "id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, drops_space: bool = False) -> DataFrame:
    """docs (id, text) -> one row for each piece; only texts of more than ``capacity`` ids are cut, the first piece taking the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, drops_space)
        for batch in pieces(batches, "text"):
            ids, off = with_end(*encode(batch.column("text")), end_id)
            n = np.diff(off)
            count = -(-n // capacity)
            text = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(piece > 0, head[text] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[text])
            data = memoryview(ids.astype("<u4").tobytes())
            lo = off[text] + start
            crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "crc"],
            )

    return docs.mapInArrow(run, "id long, piece int, start long, length long, crc long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items come largest first, each goes where it leaves least room. Free room is found in a bit set."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        free[left].append(b)
        rooms |= 1 << left
    return bins


def _slabs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            piece = batch.slice(i, most)
            if held and rows + piece.num_rows > most:
                yield held
                held, rows = [], 0
            held.append(piece)
            rows += piece.num_rows
    if held:
        yield held


def _round(capacity: int, slack: int, last: bool, most: int):
    """Pack one partition's items, ``most`` at a time; bins with at most ``slack`` room are done, and all are in the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _slabs(batches, most):
            yield from pack_slab(got)

    def pack_slab(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got).combine_chunks()
        used, members = table.column("used").to_numpy(), table.column("members").combine_chunks()
        off, flat = members.offsets.to_numpy().astype(np.int64), members.values
        first = off[:-1]
        order = np.lexsort((flat.field("piece").to_numpy()[first], flat.field("id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)[first], -used))
        bins = best_fit(used[order].tolist(), capacity)
        size = np.array([len(b) for b in bins])
        item = order[np.array([i for b in bins for i in b])]
        total = np.add.reduceat(used[item], np.cumsum(size) - size)
        n = off[item + 1] - off[item]
        take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[item], n)
        bounds = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(size)]]
        new = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat.take(pa.array(take)))
        done = np.ones(len(bins), bool) if last else total >= capacity - slack
        out = pa.RecordBatch.from_arrays([pa.array(done), pa.array(total.astype(np.int32)), new], ["done", "used", "members"])
        for i in range(0, len(out), 20_000):
            yield out.slice(i, 20_000)

    return run


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        members = b.column("members")
        count = np.diff(members.offsets.to_numpy())
        flat = members.flatten()
        length = flat.field("length").to_numpy()
        ends = np.cumsum(length)
        first = np.repeat(np.cumsum(count) - count, count)
        offset = ends - length - (ends - length)[first] if len(length) else length
        bin_ = np.repeat(b.column("bin").to_numpy(), count)
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("id", "piece", "start", "length", "crc")), pa.array(bin_), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "bin", "offset"])


def pack(items: DataFrame, capacity: int, slack: int = 4, fan_in: int = 8, task_items: int = 200_000) -> DataFrame:
    """Pieces (id, piece, start, length, crc) -> the same with ``bin`` and ``offset``: bins of at most ``capacity``.

    Pieces as long as a bin are bins. The others are packed by partition; bins with more than ``slack`` room go on as
    items to a round on ``fan_in`` times fewer partitions, and so on up the tree. A task packs at most ``task_items``
    items at once: a larger split of the first round is packed in slabs of that many, and where more are left over for the
    last round, rounds of several tasks go on as long as they save a bin in 200. Of equal sizes the smaller id, then the
    smaller piece, is placed first, null ids before all; of equally good bins the latest takes it. Ids need not be
    distinct. No pieces give no rows.
    """
    whole = items.filter(F.col("length") >= capacity)
    part = items.filter(F.col("length") < capacity)
    one = F.array(F.struct("id", "piece", "start", "length", "crc"))
    now = part.select(F.lit(False).alias("done"), F.col("length").cast("int").alias("used"), one.alias("members"))
    packed = [whole.select(one.alias("members"))]
    left = before = parts = None
    while True:
        last = parts == 1 or (parts is not None and before is not None and left > before * 0.995)
        after, next_path = materialize(now.mapInArrow(_round(capacity, slack, last, 2 * task_items), BIN), "bins")
        packed.append(after.filter("done").select("members"))
        if last:
            break
        files, count = after.filter("not done").select(F.input_file_name().alias("f")).agg(F.countDistinct("f"), F.count("*")).first()
        left, before = count, left
        if not left:
            break
        fewest = -(-left // task_items)
        start = parts or files
        if parts == fewest and parts > 1:
            parts = fewest  # a further round among as many, until it no longer pays
        else:
            parts, before = max(fewest, -(-start // fan_in)), None
        now = after.filter("not done").repartition(parts)
    bins = packed[0]
    for p in packed[1:]:
        bins = bins.union(p)
    return bins.select(F.monotonically_increasing_id().alias("bin"), "members").mapInArrow(_lay_out, OUT)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as token ids with an end id, packed into as few sequences as best fit can: see ``pack``.

    Null and empty texts are an end id alone; texts of more than ``capacity`` ids, however long, are cut; repeated rows are
    documents of their own; an empty table gives no rows; other columns, clashing names too, are left behind.
    """
    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    items, _ = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(items, capacity)


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    found = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or tokenizer_path(TOKENIZER))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
