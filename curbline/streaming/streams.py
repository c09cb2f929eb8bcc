"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, by: str, ts: str, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a group: rows at most gap apart. A row exactly gap after the one before is still in its session."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts")).select(by, F.col("w.start").alias("first_ts"), "last_ts", "n")


def windowed_counts(stream: DataFrame, ts: str, keys: tuple[str, ...], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling, or with slide sliding, counts and sums by event time."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_of_each(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def new_only(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a batch holds that is not done yet."""
    return batch.join(done.select(key), key, "left_anti").dropDuplicates([key])


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into a Parquet folder, and ends. A second call with the same checkpoint takes only what is new."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_each(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def file_stream(spark: SparkSession, path: str, schema: Any, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
