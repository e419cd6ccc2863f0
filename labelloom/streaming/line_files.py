"""Incremental analysis: files of lines as a stream, each batch analysed as a whole. An extra beyond batch use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LINES = "package_id bigint, index int, text string, confidence double, box array<array<double>>, source string"


def stream_packages(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call `handle(lines, batch)` for new JSON files; packages must not span files of different batches."""
    lines = spark.readStream.schema(LINES).json(path)
    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
