"""Exact ranks over tables of any size: counted within ranges, the ranges' counts added after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What stands for a key that is null.
NULL = "\x00null"


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, one for each stem."""
    have = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, k = f"_{stem}", 0
        while name in have:
            name, k = f"_{stem}{k}", k + 1
        have.add(name)
        out.append(name)
    return out


def hash_of(key: str, seed: int) -> Column:
    """The order of a seeded shuffle; the same in any engine with MD5. Null stands for a text of its own."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit(NULL)), F.lit(f":{seed}")))


def shuffled_rank(df: DataFrame, key: str, seed: int, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with a 1-based rank in the order of hash_of(key), within groups; a group is dealt over 256 ranges of the hash.

    Every row gets a rank: a null key is a key, a null group a group, and rows that repeat a key stand next to each other.
    """
    groups = within or []
    h, b, n = unused(df, "h", "b", "n")
    gs = [f"_group{i}" for i in range(len(groups))]
    hashed = df.withColumn(h, hash_of(key, seed)).withColumn(b, F.substring(h, 1, 2))
    sums = hashed.groupBy(*groups, b).agg(F.count("*").alias("_count"))
    before = sums.select(*[F.col(g).alias(x) for g, x in zip(groups, gs, strict=True)], F.col(b).alias("_other"), (F.sum("_count").over(Window.partitionBy(*groups).orderBy(b)) - F.col("_count")).alias("_before"))
    inner = hashed.withColumn(n, F.row_number().over(Window.partitionBy(*groups, b).orderBy(h, key))).alias("l")
    on = F.col(f"l.{b}") == F.col("r._other")
    for g, x in zip(groups, gs, strict=True):
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{x}"))
    rank = (F.col(f"l.{n}") + F.col("r._before")).cast("long").alias(name)
    return inner.join(before.alias("r"), on).select(*[F.col(f"l.`{c}`") for c in df.columns if c != name], rank)


def global_rank(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with a 0-based rank in the order of columns, by range partitions and their counts; nulls stand first."""
    p, n = unused(df, "p", "n")
    dealt = df.repartitionByRange(*order).withColumn(p, F.spark_partition_id())
    inner = dealt.withColumn(n, F.row_number().over(Window.partitionBy(p).orderBy(*order)) - 1).alias("l")
    sums = dealt.groupBy(p).agg(F.count("*").alias("_count"))
    before = sums.select(F.col(p).alias("_other"), (F.sum("_count").over(Window.orderBy(p)) - F.col("_count")).alias("_before"))
    # one row per partition
    joined = inner.join(F.broadcast(before.alias("r")), F.col(f"l.{p}") == F.col("r._other"))
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns if c != name], (F.col(f"l.{n}") + F.col("r._before")).cast("long").alias(name))
