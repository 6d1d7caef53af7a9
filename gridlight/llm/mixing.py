"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The mix has as many slots as the targets have blocks of words. Slot i = 0, 1, 2, ... takes the source in whose share of the
cumulative targets the golden-ratio point frac(i * phi) lies, so that every stretch of the mix is close to the targets. The
n-th slot of a source joins the n-th block of its shuffled words, all blocks being equally long; a source whose words are used
up starts again, three times at most. What a source gives is decided by its slots: a few blocks less than its target, where
the points fall short of its share, and never more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlight.llm.common import durable, n_words

#: Weights by position of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used so many times at most.
REPEATS = 3
#: Words of a block.
BLOCK = 32
#: Slots whose ranks are counted together, and cells of the unit interval by which points meet their source.
CHUNK, GRID = 1 << 16, 4096
#: The golden ratio, and the fraction of its multiple by STRIDE: so points stay exact however many slots there are.
PHI, STRIDE = 0.6180339887498949, 1 << 24
PHI_STRIDE = math.isqrt(5 * (STRIDE << 63) ** 2) % (1 << 64) / (1 << 64)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target per source: all words are shared by weight, no source gets over ``repeats`` times its size.

    Sources in the order of size / weight: those that stop come first, so one pass settles the sharing. The table
    worked on has one row per source, not per document.
    """
    by = Window.orderBy(F.col("source").isNull(), F.col("source"))  # UTF-8 order is code point order
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int"))
    room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, onward, everything = room.rowsBetween(Window.unboundedPreceding, -1), room.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    out = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(everything))
    )
    cap = F.col("cap").cast("double")
    return out.select("source", "source_size", F.when(F.col("open"), F.least(F.col("final.level") * F.col("weight"), cap)).otherwise(cap).alias("target"))


def shuffled(key: str, seed: int) -> Column:
    """The hash that orders a source's rows: of the id, or of the text where there is none."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.col("text_hash").cast("string")))))


def positions(sized: DataFrame, seed: int) -> DataFrame:
    """sized with start: the words that stand before the row in its source's shuffled order, and bucket and nth, its place.

    Sums run within 256 ranges of the hash and the ranges' totals are added after, so that a source with a third
    of all rows is dealt over 256 tasks.
    """
    mixed = sized.withColumn("h", shuffled("doc_id", seed)).withColumn("bucket", F.substring("h", 1, 2))
    totals = mixed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("offset"))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "text_hash")
    ranked = mixed.withColumn("nth", F.row_number().over(order)).withColumn("inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return (
        ranked.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("start", F.col("inner") + F.col("offset"))
        .drop("o_source", "o_bucket", "offset", "inner", "h")
    )


def golden(slot: Column) -> Column:
    """frac(slot * phi)."""
    x = F.floor(slot / STRIDE) * F.lit(PHI_STRIDE) + (slot % STRIDE) * F.lit(PHI)
    return x - F.floor(x)


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, rank: the golden-ratio schedule; rank numbers the slots of a source. shares has source and quota."""
    spark = shares.sparkSession
    total = int(shares.agg(F.sum("quota")).first()[0] or 0)
    slots = max((total + block // 2) // block, int(total > 0))
    upto = F.sum("quota").over(Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0))
    ends = shares.where("quota > 0").select("source", (upto - F.col("quota")).alias("lo"), upto.alias("hi"))
    cells = F.explode(F.sequence(F.floor(F.col("lo") / max(total, 1) * GRID), F.least(F.floor(F.col("hi") / max(total, 1) * GRID), F.lit(GRID - 1)))).alias("cell")
    points = spark.range(slots).select(F.col("id").alias("slot"), golden(F.col("id")).alias("point"))
    place = F.col("point") * F.lit(float(total))
    hit = points.withColumn("cell", F.floor(F.col("point") * GRID)).join(ends.select("source", "lo", "hi", cells), "cell").where((place >= F.col("lo")) & (place < F.col("hi")))
    chunked = hit.select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = chunked.groupBy("source", "chunk").count()
    before = counts.select(F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), (F.sum("count").over(Window.partitionBy("source").orderBy("chunk")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return (
        chunked.withColumn("inner", inner)
        .join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("chunk") == F.col("b_chunk")))
        .select("slot", "source", (F.col("inner") + F.col("before")).cast("long").alias("rank"))
    )


def take(docs: DataFrame, seed: int = 11, block: int = BLOCK, schedule=schedule) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken, first_slot per input row.

    The words of a source, in shuffled order, repeat without end; its n-th slot takes words [n * block, (n + 1) * block)
    of them, up to the target rounded to a whole word. first_slot is the slot that a document's first taken word stands in, null
    if none is taken. Null texts have size 0 and are never taken; the null source is a source; repeated rows are separate
    rows; the empty table gives no rows; other columns are ignored. ``schedule`` maps source and quota to slot, source, rank.
    """
    sized = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    shares = durable(shares.withColumn("quota", F.least(F.round("target").cast("long"), REPEATS * F.col("source_size"))), "shares")
    slots = schedule(shares.select("source", "quota"), block).select(F.col("source").alias("s_source"), F.col("rank").alias("s_block"), "slot")
    known = shares.select(F.col("source").alias("k_source"), "source_size", "target", "quota")
    placed = positions(sized, seed).join(known, F.col("source").eqNullSafe(F.col("k_source"))).drop("k_source")
    # words [a, b) of the repeated source are what a row holds in one round; b stops at the quota
    rounds = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda r: r * F.col("source_size") + F.col("start"))
    used = F.filter(rounds, lambda a: (F.col("size") > 0) & (a < F.col("quota")))
    parts = (
        placed.withColumn("a", F.explode_outer(used))
        .withColumn("b", F.least(F.col("a") + F.col("size"), "quota"))
        .withColumn("block", F.explode_outer(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    )
    joined = parts.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")), "left")
    words = F.when(F.col("slot").isNotNull(), F.least(F.col("b"), (F.col("block") + 1) * block) - F.greatest(F.col("a"), F.col("block") * block)).otherwise(F.lit(0))
    same = ["doc_id", "source", "text_hash", "size", "source_size", "target", "bucket", "nth"]
    return joined.groupBy(*same).agg(F.sum(words).cast("long").alias("taken"), F.min_by("slot", "block").alias("first_slot")).drop("bucket", "nth")


def mixed(docs: DataFrame, seed: int = 11, block: int = BLOCK, ordered: bool = False) -> DataFrame:
    """The mix itself, with the columns of docs: a row for every whole use of a document, and one, cut after the words
    that the last block still takes, for a use in part; n_chars (if any) follows the text. ``ordered`` sorts it by the slots in
    which documents begin, so that every stretch of it is close to the targets."""
    # a struct as key: its parts may be null, and one shuffle serves the join and the ranks
    unit = F.struct("doc_id", "source", "text_hash").alias("unit")
    taken = take(docs, seed, block).groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("taken", "size", "first_slot"))).alias("uses"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.doc_id", "row.source", F.xxhash64("row.text").alias("text_hash")).select("row", unit)
    # rows that repeat one document take its uses in turn
    nth = F.row_number().over(Window.partitionBy("unit").orderBy(F.xxhash64("row")))
    rows = keyed.join(taken, "unit").withColumn("nth", nth).select("row", F.element_at("uses", F.col("nth")).alias("own"))
    whole, rest = F.expr("coalesce(own.taken div nullif(own.size, 0), 0)"), F.expr("coalesce(own.taken % nullif(own.size, 0), 0)")
    uses = F.concat(F.array_repeat(F.lit(None).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    head = F.expr(r"array_join(slice(regexp_extract_all(row.text, '([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)', 1), 1, cast(words AS int)), '')")
    cut = rows.select("row", F.col("own.first_slot").alias("slot"), F.posexplode(uses).alias("nth", "words"))
    cut = cut.orderBy("nth", "slot") if ordered else cut
    cut = cut.select("row", F.when(F.col("words").isNull(), F.col("row.text")).otherwise(head).alias("cut"))
    made = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The contract's columns, and first_slot."""
    return take(docs, seed).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM z),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
f AS (SELECT *, min(CASE WHEN cap >= level * weight THEN {{'at': cap / weight, 'level': level}} END) OVER () AS final FROM v),
s AS (SELECT source, source_size, CASE WHEN cap >= level * weight THEN least(final.level * weight, cap::DOUBLE) ELSE cap::DOUBLE END AS target FROM f),
q AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS quota FROM s),
c AS (SELECT *, (sum(quota) OVER (ORDER BY source IS NULL, source ROWS UNBOUNDED PRECEDING))::BIGINT AS hi, (sum(quota) OVER ())::BIGINT AS total FROM q),
i AS (SELECT unnest(range(greatest((total + {BLOCK // 2}) // {BLOCK}, (total > 0)::BIGINT))) AS slot FROM (SELECT max(total) AS total FROM c)),
x AS (SELECT slot, (slot // {STRIDE})::DOUBLE * {PHI_STRIDE!r}::DOUBLE + (slot % {STRIDE})::DOUBLE * {PHI!r}::DOUBLE AS x FROM i),
r AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM x JOIN c ON (x - floor(x)) * total::DOUBLE >= hi - quota AND (x - floor(x)) * total::DOUBLE < hi),
k AS (SELECT source, count(*) * {BLOCK} AS given FROM r GROUP BY source),
p AS (SELECT doc_id, d.source, size, source_size, target, least(quota, coalesce(given, 0)) AS upto,
        (sum(size) OVER (PARTITION BY d.source ORDER BY md5('11:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, upto) - start) + greatest(0, least(start + size, upto - source_size) - start)
  + greatest(0, least(start + size, upto - 2 * source_size) - start))::BIGINT AS taken, CASE WHEN size > 0 THEN r.slot END AS first_slot
FROM p LEFT JOIN r ON p.source IS NOT DISTINCT FROM r.source AND r.rank = start // {BLOCK} AND start < upto
"""
