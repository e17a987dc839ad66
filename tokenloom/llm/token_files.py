"""Token ids in ORC: integer run-length encoding, a row index and Bloom filters on document ids, stripes read in parallel."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import pieces
from ._spark import new_path, partitions_for, pick
from .encoding import encoder, with_end

SCHEMA = "id long, part int, local_start long, ids array<int>"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    drops_space: bool = True, stripe_bytes: int = 16 << 20, stride: int = 1000, range_bytes: int = 64 << 20,
) -> None:
    """Encode every whole text, append ``end_id``, and write ORC files in ascending order of id (null ids first).

    Documents are dealt out by ranges of ids and sorted before they are encoded, so text moves once and ids never. Each
    row holds its id, the number of its range, its start among that range's ids, and the ids. There are as many ranges as
    keep each at about ``range_bytes`` of input. Rows that share an id, null or not, come in order of a hash of their text and may
    take several ranges. Null texts are empty; repeated rows are written as often as they come; an empty table gives no
    rows; other columns, clashing names too, are left behind. A very long text is one row, encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer, drops_space), TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text"):
            ids, off = with_end(*encode(piece.column("text")), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array(np.full(piece.num_rows, part, np.int32)),
                    pa.array(at + off[:-1]),
                    pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                ],
                ["id", "part", "local_start", "ids"],
            )
            at += int(off[-1])

    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    ranges, docs = partitions_for(docs, range_bytes), docs.withColumn("tie", F.xxhash64("text"))
    rows = docs.repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie").mapInArrow(run, SCHEMA)
    options = {"orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_bytes)}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids): start counts the ids of all rows before. Filters on id reach the files' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.max(F.col("local_start") + F.size("ids")).alias("n"))
    # one row for each file's range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(starts, "part").select("id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        off = ids.offsets.to_numpy()
        data = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
        crc = np.array([zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("start"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc)],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer or tokenizer_path(TOKENIZER))
    return read_tokens(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
