"""Column statistics of vectors, fitted on one table and applied to others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.functions.pixels import as_doubles, scale_with, standardise_with


@dataclass(frozen=True)
class ColumnStats:
    """Per component: low, high, mean, std (of the population, or of the sample)."""

    low: list[float]
    high: list[float]
    mean: list[float]
    std: list[float]

    def literal(self, name: str) -> Column:
        return F.array(*map(F.lit, getattr(self, name)))


def column_stats(df: DataFrame, vector: str, sample: bool = False) -> ColumnStats:
    """One aggregation over all rows; partial sums per task, one row per component to the driver."""
    long = df.select(F.posexplode(as_doubles(F.col(vector))).alias("i", "x"))
    std = F.stddev_samp("x") if sample else F.stddev_pop("x")
    rows = long.groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.coalesce(std, F.lit(0.0)).alias("std")).orderBy("i").collect()
    return ColumnStats([r.low for r in rows], [r.high for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])


def minmax(df: DataFrame, vector: str, stats: ColumnStats, out: str = "scaled", eps: float = 1e-8) -> DataFrame:
    return df.withColumn(out, scale_with(as_doubles(F.col(vector)), stats.literal("low"), stats.literal("high"), eps))


def standardise(df: DataFrame, vector: str, stats: ColumnStats, out: str = "scaled") -> DataFrame:
    return df.withColumn(out, standardise_with(as_doubles(F.col(vector)), stats.literal("mean"), stats.literal("std")))


def element_range(df: DataFrame, vector: str) -> tuple[float, float, float, float]:
    """min, max, mean, population std over all elements of all rows."""
    flat = df.select(F.explode(as_doubles(F.col(vector))).alias("x"))
    r = flat.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.avg("x").alias("c"), F.stddev_pop("x").alias("d")).first()
    return r.a, r.b, r.c, r.d
