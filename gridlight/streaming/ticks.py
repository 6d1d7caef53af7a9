"""Streams: a clock, and scoring of arriving rows (an extension: the batch functions run unchanged on a stream)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.functions.names import tick


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """An endless stream with one formatted line per tick."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(tick(F.col("timestamp")).alias("line"))


def score_stream(spark: SparkSession, folder: str, schema, score: Callable[[DataFrame], DataFrame], per_trigger: int = 16) -> DataFrame:
    """Scores of Parquet files as they arrive in a folder."""
    return score(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder))


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; state of windows that can get no more rows is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).count().select("window.start", "window.end", key, "count")
