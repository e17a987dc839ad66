"""The same operators on streams: stateless, so no watermark is needed; patterns are a static side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..engine import finish
from ..operators import sequence


def decoded(responses: DataFrame) -> DataFrame:
    """Decode and repair a stream of (sent_id, sentence, response)."""
    return finish(responses)


def matches(sentences: DataFrame, patterns: DataFrame, key: str = "text") -> DataFrame:
    """Matches in a stream of annotated sentences, joined to a static table of patterns."""
    return sequence.find_all(sentences, patterns, key)


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once sink; call start() on it."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
