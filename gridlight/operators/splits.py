"""Splits, samples and picks. All are seeded by a hash of the id, so they do not depend on partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlight.operators.ranking import NULL, global_rank, hash_of, shuffled_rank, unused


def allocate(counts: DataFrame, label: str, n: str, share: float, name: str) -> DataFrame:
    """counts with ``name``: ceil(share * all) rows dealt to labels by largest remainder, ties to the smaller label."""
    every = Window.partitionBy()
    want = F.ceil(F.lit(share) * F.sum(n).over(every))
    exact = F.col(n) * want / F.sum(n).over(every)
    out = counts.withColumn("_want", want).withColumn("_floor", F.floor(exact)).withColumn("_part", exact - F.col("_floor"))
    out = out.withColumn("_missing", F.col("_want") - F.sum("_floor").over(every))
    nth = F.row_number().over(Window.orderBy(F.desc("_part"), label))
    return out.withColumn("_nth", nth).withColumn(name, (F.col("_floor") + (F.col("_nth") <= F.col("_missing")).cast("int")).cast("long")).drop("_want", "_floor", "_part", "_missing", "_nth")


def stratified_split(df: DataFrame, key: str, label: str, held: float = 0.2, test_of_held: float = 0.5, seed: int = 42) -> DataFrame:
    """df with split: per label, ``held`` of the rows go to val and test, ``test_of_held`` of those to test. Totals are exact;
    rows without a key or a label are dealt like others."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))  # one row per label
    plan = allocate(allocate(counts, label, "n", held, "held"), label, "held", test_of_held, "test")
    [rank] = unused(df, "rank")
    ranked = shuffled_rank(df, key, seed, [label], rank)
    sizes = plan.select(F.col(label).alias("_label"), "held", "test").alias("r")
    joined = ranked.alias("l").join(sizes, F.col(f"l.{label}").eqNullSafe(F.col("r._label")))
    split = F.when(F.col(f"l.{rank}") <= F.col("r.held") - F.col("r.test"), "val").when(F.col(f"l.{rank}") <= F.col("r.held"), "test").otherwise("train")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns if c != "split"], split.alias("split"))


def train_test_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split train or test, per label."""
    return stratified_split(df, key, label, share, 1.0, seed)


def group_split(df: DataFrame, group: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """df with split: max(1, int(share * groups)) whole groups go to val. Rows without a group are one group."""
    groups = df.select(group).distinct()
    n = groups.count()
    ranked = shuffled_rank(groups, group, seed).withColumn("split", F.when(F.col("rank") <= max(1, int(n * share)), "val").otherwise("train"))
    sides = ranked.select(F.col(group).alias("_group"), "split").alias("r")
    columns = [F.col(f"l.`{c}`") for c in [group, *(c for c in df.columns if c not in (group, "split"))]]
    return df.alias("l").join(sides, F.col(f"l.{group}").eqNullSafe(F.col("r._group"))).select(*columns, "r.split")


def leaks(df: DataFrame, group: str) -> DataFrame:
    """Groups that stand on more than one side of a split."""
    return df.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(group)


def evenly_spaced(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The rows of ranks floor(i * N / n), i = 0 .. n - 1, with nth = i."""
    ranked = global_rank(df, *order)
    total = df.count()
    picks = df.sparkSession.range(n).select(F.col("id").cast("int").alias("nth"), F.floor(F.col("id") * total / n).cast("long").alias("pos"))
    return ranked.join(F.broadcast(picks), "pos")


def nth_of_class(df: DataFrame, n: int, label: str, order: str) -> DataFrame:
    """Per class the row number n (from 0) in the order of a column."""
    [nth] = unused(df, "n")
    # the limit on ranks keeps n + 1 rows of a class per task, so that a large class is cut before it is shuffled
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col(nth) <= n + 1).where(F.col(nth) == n + 1).drop(nth)


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def every_kth(df: DataFrame, batch: int, most: int, *order: str) -> DataFrame:
    """Rows of every k-th batch, so that at most ``most`` batches stay, spread over all of them."""
    total = -(-df.count() // batch)
    step = max(1, total // most)
    placed = global_rank(df, *order).withColumn("batch", F.floor(F.col("pos") / batch).cast("long"))
    return placed.where((F.col("batch") % step == 0) & (F.col("batch") < step * most))


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly n rows (all, if fewer), without replacement, the same for the same seed."""
    [h] = unused(df, "h")
    return df.withColumn(h, hash_of(key, seed)).orderBy(h, key).limit(n).drop(h)


def at_positions(df: DataFrame, positions: list[int], *order: str) -> DataFrame:
    return global_rank(df, *order).where(F.col("pos").isin(positions))


def hash_in_python(key: str | None, seed: int) -> str:
    """What ranking.hash_of gives for a key as text."""
    return hashlib.md5(f"{NULL if key is None else key}:{seed}".encode()).hexdigest()


def epoch_seed(seed: int, epoch: int) -> int:
    return seed * 1_000_003 + epoch


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """df in a new order for each epoch."""
    [h] = unused(df, "h")
    return df.withColumn(h, hash_of(key, epoch_seed(seed, epoch))).orderBy(h, key).drop(h)


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """df with batch, its number of batch in the order given."""
    return global_rank(df, *order).withColumn("batch", F.floor(F.col("pos") / size).cast("long"))
