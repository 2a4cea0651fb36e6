"""Bounded incremental runs: what has come since the last run, and nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 1000) -> None:
    """Applies a stateless transformation to the files of ``source`` that no earlier run with this checkpoint has read.

    At most ``files`` files make a batch. The log in ``checkpoint`` makes a run that was broken off go on where it stopped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_distinct(spark: SparkSession, source: str, schema: str, key: list[str], event_time: str, delay: str, target: str, checkpoint: str) -> None:
    """As ``run_available``, dropping rows whose key came before within ``delay`` of event time."""
    stream = spark.readStream.schema(schema).parquet(source).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
