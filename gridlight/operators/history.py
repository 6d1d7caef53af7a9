"""Training histories as tables: run, epoch, metric value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tracked(history: DataFrame, metric: str, lower: bool, run: str) -> DataFrame:
    """history with improved, and last_best: the epoch of the best value so far."""
    by = Window.partitionBy(run).orderBy("epoch")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(metric).over(before) if lower else F.max(metric).over(before)
    better = best.isNull() | ((F.col(metric) < best) if lower else (F.col(metric) > best))
    return history.withColumn("improved", better).withColumn("last_best", F.max(F.when(F.col("improved"), F.col("epoch"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def early_stop(history: DataFrame, metric: str, patience: int, lower: bool = True, run: str = "run_id") -> DataFrame:
    """run, stopped_at (null: ran to the end) and restored, the epoch whose weights stay."""
    tracked = _tracked(history, metric, lower, run)
    stops = tracked.groupBy(run).agg(F.min(F.when(F.col("epoch") - F.col("last_best") >= patience, F.col("epoch"))).alias("stopped_at"), F.max("last_best").alias("_last"))
    joined = tracked.join(stops, run).where(F.col("stopped_at").isNull() | (F.col("epoch") <= F.col("stopped_at")))
    return joined.groupBy(run, "stopped_at").agg(F.max("last_best").alias("restored"))


def best_epoch(history: DataFrame, metric: str, lower: bool = True, run: str = "run_id") -> DataFrame:
    """run, epoch and value of the best checkpoint, the first of equal ones."""
    order = F.struct(F.col(metric) if lower else -F.col(metric), F.col("epoch"))
    return history.groupBy(run).agg(F.min_by("epoch", order).alias("epoch"), F.min_by(metric, order).alias(metric))


def lr_plateau(history: DataFrame, metric: str, rate: float, factor: float = 0.5, patience: int = 5, floor: float = 1e-7, lower: bool = True, run: str = "run_id") -> DataFrame:
    """history with lr, the rate after each epoch: cut every ``patience`` epochs without a better value."""
    tracked = _tracked(history, metric, lower, run)
    waited = F.col("epoch") - F.col("last_best")
    cut = ((waited > 0) & (waited % patience == 0)).cast("int")
    cuts = F.sum(cut).over(Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return tracked.withColumn("lr", F.greatest(F.lit(rate) * F.pow(F.lit(factor), cuts), F.lit(floor))).drop("improved", "last_best")
