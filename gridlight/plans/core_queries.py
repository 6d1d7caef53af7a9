"""Registered queries of the core library, with the DuckDB statement that gives the same rows.

Doubles that come from sums are rounded to six digits on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.functions import names, pixels
from gridlight.operators import history as hist
from gridlight.operators import metrics, nets, noise, pca, ranking, reservoir, scaling, splits, tiles
from gridlight.plans import tables as t
from gridlight.streaming import ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# pieces of the statements: vectors, long pixels scaled to 0..1, made-up tables
_V = "e AS (SELECT vec_id AS image_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_P = f"""{_V}, raw AS (SELECT image_id, label, u.i - 1 AS i, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i)),
lim AS (SELECT min(x) AS lo, max(x) AS hi FROM raw),
p AS (SELECT image_id, label, (i // 8)::INT AS y, (i % 8)::INT AS x, i, (raw.x - lo) / (hi - lo) AS value FROM raw, lim)"""
_I = f"{_P}, img AS (SELECT image_id, label, list(value ORDER BY i) AS px FROM p GROUP BY image_id, label)"
_SHUFFLE = "md5(vec_id || ':42'), vec_id"
_PROBS = """w AS (SELECT i AS sample, i // 4 AS image, ((i * 2) % 3)::INT AS label, (i * 3) % 7 + 1 AS a, (i * 3 + 5) % 7 + 1 AS b, (i * 3 + 10) % 7 + 1 AS c FROM range(12) AS r(i)),
q AS (SELECT sample, image, label, [a::DOUBLE / (a + b + c), b::DOUBLE / (a + b + c), c::DOUBLE / (a + b + c)] AS p FROM w)"""
_HISTORY = "h AS (SELECT 'run' AS run_id, i::INT AS epoch, abs(i - 25) / 100.0::DOUBLE + 0.1::DOUBLE AS val_loss FROM range(60) AS r(i))"
_PALETTE = "pal(class_id, name, r, g, b) AS (VALUES " + ", ".join(str(row) for row in tiles.PALETTE) + ")"
_RGB = f"{_PALETTE}, col AS (SELECT class_id, r, g, b FROM pal UNION ALL SELECT 7, 1, 2, 3), px AS (SELECT (i // 8)::INT AS y, (i % 8)::INT AS x, r, g, b FROM range(64) AS q(i) JOIN col ON i % 8 = class_id)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _split_oracle(rest: str) -> str:
    return f"""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
a AS (SELECT *, ceil(0.2::DOUBLE * sum(n) OVER ()) AS want, n * ceil(0.2::DOUBLE * sum(n) OVER ())::DOUBLE / (sum(n) OVER ())::DOUBLE AS ex FROM n),
b AS (SELECT label, n, floor(ex) + (row_number() OVER (ORDER BY ex - floor(ex) DESC, label) <= want - sum(floor(ex)) OVER ())::INT AS held FROM a),
c AS (SELECT *, ceil(0.5::DOUBLE * sum(held) OVER ()) AS want, held * ceil(0.5::DOUBLE * sum(held) OVER ())::DOUBLE / (sum(held) OVER ())::DOUBLE AS ex FROM b),
d AS (SELECT label, held, floor(ex) + (row_number() OVER (ORDER BY ex - floor(ex) DESC, label) <= want - sum(floor(ex)) OVER ())::INT AS test FROM c),
s AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {_SHUFFLE}) AS k FROM embeddings),
x AS (SELECT vec_id AS image_id, s.label, list_transform(embedding, lambda z: z::DOUBLE) AS v, CASE WHEN k <= held - test THEN 'val' WHEN k <= held THEN 'test' ELSE 'train' END AS split FROM s JOIN d ON s.label = d.label)
{rest}"""


def _split(spark, sf) -> DataFrame:
    return splits.stratified_split(t.vectors(spark, sf), "image_id", "label")


@query(_split_oracle("""SELECT split, label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(v, lambda z: z * z)))), 6) AS mean_norm,
round(min(list_min(v)), 6) AS low, round(max(list_max(v)), 6) AS high FROM x GROUP BY split, label"""))
def split_label_stats(spark, sf):
    """Flagship: split by label, then size, mean norm and range per split and label."""
    return _split(spark, sf).groupBy("split", "label").agg(F.count("*").alias("n"), r6(F.avg(pixels.l2_norm(F.col("v")))).alias("mean_norm"), r6(F.min(F.array_min("v"))).alias("low"), r6(F.max(F.array_max("v"))).alias("high"))


@query(_split_oracle("SELECT split, label, count(*) AS n FROM x GROUP BY split, label"))
def stratified_split_counts(spark, sf):
    return _split(spark, sf).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(_split_oracle("SELECT image_id, split FROM x"))
def stratified_split_rows(spark, sf):
    return _split(spark, sf).select("image_id", "split")


@query("""SELECT 'brand' AS kind, p_brand AS name, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS label FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 'event', event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT FROM (SELECT DISTINCT event_type FROM events)""")
def label_index(spark, sf):
    from pyspark.sql import Window

    one = lambda kind, name, col: t.table(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(col).alias("name")).distinct()
    both = one("brand", "part", "p_brand").unionByName(one("event", "events", "event_type"))
    return both.withColumn("label", (F.dense_rank().over(Window.partitionBy("kind").orderBy("name")) - 1).cast("int"))


_GROUPS = """WITH g AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id || ':42'), conv_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
s AS (SELECT conv_id, CASE WHEN k <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM g)
"""


@query(_GROUPS + "SELECT c.conv_id, c.turn, split FROM conversations c JOIN s USING (conv_id)")
def group_split(spark, sf):
    return splits.group_split(t.table(spark, sf, "conversations"), "conv_id").select("conv_id", "turn", "split")


@query(_GROUPS + """, r AS (SELECT c.conv_id, split FROM conversations c JOIN s USING (conv_id))
SELECT split, count(DISTINCT conv_id) AS n_groups, count(*) AS n_rows, count(DISTINCT conv_id) FILTER (WHERE conv_id IN (SELECT conv_id FROM r GROUP BY conv_id HAVING count(DISTINCT split) > 1)) AS n_leaking FROM r GROUP BY split""")
def group_split_leakage_check(spark, sf):
    """Groups, rows and leaking groups of either side."""
    parts = splits.group_split(t.table(spark, sf, "conversations"), "conv_id")
    leaking = splits.leaks(parts, "conv_id").select("conv_id", F.lit(1).alias("leak"))
    marked = parts.join(leaking, "conv_id", "left")
    return marked.groupBy("split").agg(F.countDistinct("conv_id").alias("n_groups"), F.count("*").alias("n_rows"), F.countDistinct(F.when(F.col("leak") == 1, F.col("conv_id"))).alias("n_leaking"))


@query(_GROUPS + "SELECT c.conv_id, c.turn FROM conversations c ANTI JOIN (SELECT conv_id FROM s WHERE split = 'val') v USING (conv_id)")
def split_anti(spark, sf):
    """Train is what is not val."""
    df = t.table(spark, sf, "conversations")
    val = splits.group_split(df, "conv_id").where("split = 'val'").select("conv_id").distinct()
    return df.join(val, "conv_id", "left_anti").select("conv_id", "turn")


def _pairs(spark, sf, how):
    return tiles.pair(t.table(spark, sf, "documents").select("doc_id", "source"), t.table(spark, sf, "labels"), ["doc_id"], how)


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def pair_inner(spark, sf):
    return _pairs(spark, sf, "inner")


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def pair_left(spark, sf):
    return _pairs(spark, sf, "left").fillna(-1, ["quality", "toxic"])


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def pair_semi(spark, sf):
    return _pairs(spark, sf, "left_semi")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def pair_missing(spark, sf):
    return _pairs(spark, sf, "left_anti")


@query("SELECT conv_id, count(*) AS n_turns, list_sort(list(turn)) AS turns FROM conversations GROUP BY conv_id")
def tiles_of_image(spark, sf):
    return t.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))


@query(f"WITH {_RGB} SELECT y, x, coalesce(class_id, 0) AS class_id, class_id IS NOT NULL AS matched FROM px LEFT JOIN pal USING (r, g, b)")
def palette_decode(spark, sf):
    return tiles.decode(t.rgb_pixels(spark)).select("y", "x", "class_id", "matched")


@query(f"WITH {_P}, {_PALETTE} SELECT image_id, y, x, pal.r, pal.g, pal.b FROM p JOIN pal ON least(floor(value * 7), 6)::INT = class_id")
def palette_encode(spark, sf):
    return tiles.encode(tiles.long_form(t.class_ids(spark, sf), "classes", 8, ("image_id",)), "value").select("image_id", "y", "x", "r", "g", "b")


@query(f"""WITH {_I} SELECT image_id, u.k - 1 AS i, round(0.299::DOUBLE * px[3 * u.k - 2] + 0.587::DOUBLE * px[(3 * u.k - 2) % 64 + 1] + 0.114::DOUBLE * px[(3 * u.k - 1) % 64 + 1], 6) AS gray
FROM img, unnest(range(1, 23)) AS u(k)""")
def grayscale(spark, sf):
    """All 64 elements, and the first two again, as 22 pixels of three channels."""
    rgb = t.images(spark, sf).select("image_id", F.concat("pixels", F.slice("pixels", 1, 2)).alias("rgb"))
    return rgb.select("image_id", F.posexplode(pixels.grayscale(F.col("rgb"))).alias("i", "gray")).select("image_id", F.col("i").cast("long").alias("i"), r6(F.col("gray")).alias("gray"))


@query(f"""WITH {_V}, l AS (SELECT image_id, u.i - 1 AS i, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i)), s AS (SELECT i, min(x) AS lo, max(x) AS hi FROM l WHERE image_id % 5 <> 0 GROUP BY i)
SELECT image_id, l.i, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - lo) / (hi - lo + 1e-8))), 6) AS z FROM l JOIN s ON l.i = s.i""")
def minmax_scale(spark, sf):
    """Scaled by the rows that are trained on, and cut to 0..1 for the others."""
    df = t.vectors(spark, sf)
    out = scaling.minmax(df, "v", scaling.column_stats(df.where("image_id % 5 <> 0"), "v"))
    return out.select("image_id", F.posexplode("scaled").alias("i", "z")).select("image_id", F.col("i").cast("long").alias("i"), r6(F.col("z")).alias("z"))


@query(f"""WITH {_V}, l AS (SELECT image_id, u.i - 1 AS i, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i)), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM l WHERE image_id % 5 <> 0 GROUP BY i)
SELECT image_id, l.i, round((x - m) / d, 6) AS z FROM l JOIN s ON l.i = s.i""")
def standardise(spark, sf):
    df = t.vectors(spark, sf)
    out = scaling.standardise(df, "v", scaling.column_stats(df.where("image_id % 5 <> 0"), "v"))
    return out.select("image_id", F.posexplode("scaled").alias("i", "z")).select("image_id", F.col("i").cast("long").alias("i"), r6(F.col("z")).alias("z"))


@query(f"""WITH {_V}, l AS (SELECT u.i - 1 AS i, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i))
SELECT i, round(min(x), 6) AS low, round(max(x), 6) AS high, round_even(avg(x), 3) + 0.0 AS mean, round_even(stddev_pop(x), 3) + 0.0 AS std FROM l GROUP BY i""")
def score_stats(spark, sf):
    long = t.vectors(spark, sf).select(F.posexplode("v").alias("i", "x"))
    return long.groupBy(F.col("i").cast("long").alias("i")).agg(r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"), (F.bround(F.avg("x"), 3) + F.lit(0.0)).alias("mean"), (F.bround(F.stddev_pop("x"), 3) + F.lit(0.0)).alias("std"))


@query(f"WITH {_P} SELECT round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM p")
def element_stats(spark, sf):
    flat = t.images(spark, sf).select(F.explode("pixels").alias("x"))
    return flat.agg(r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"), r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"))


@query("""SELECT i AS image_id, round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((i * 31 + (k // 16) * 7 + (k % 16) * 13) % 256) / 255.0::DOUBLE * (1 + ((i * 7 + k * 5) % 21 - 10) / 10.0::DOUBLE)))), 6) AS mean_noisy,
round(max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((i * 31 + (k // 16) * 7 + (k % 16) * 13) % 256) / 255.0::DOUBLE * (1 + ((i * 7 + k * 5) % 21 - 10) / 10.0::DOUBLE)))), 6) AS top
FROM range(100) AS a(i), range(256) AS b(k) GROUP BY i""")
def noise_clip(spark, sf):
    """The noise model with errors by an integer rule in place of random ones."""
    eps = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: ((F.col("image_id") * 7 + k * 5) % 21 - 10) / F.lit(10.0))
    out = t.images16(spark).withColumn("noisy", noise.apply_eps(F.col("pixels"), eps))
    return out.select("image_id", F.explode("noisy").alias("x")).groupBy("image_id").agg(r6(F.avg("x")).alias("mean_noisy"), r6(F.max("x")).alias("top"))


@query()
def noise_seeded(spark, sf):
    """Speckle of 0.7 with a seed for each split."""
    df = splits.stratified_split(t.images(spark, sf), "image_id", "label")
    out = noise.speckle(df, "image_id", "pixels", 0.7, noise.seed_of_split(F.col("split")))
    return out.select("image_id", "split", r6(pixels.squared_error(F.col("noisy"), F.col("pixels"))).alias("mse"))


@query(f"""WITH {_V} SELECT a.i - 1 AS i, b.j - 1 AS j, round(covar_samp(v[a.i], v[b.j]), 6) + 0.0::DOUBLE AS cov FROM e, unnest(range(1, 65)) AS a(i), unnest(range(1, 65)) AS b(j) WHERE a.i <= b.j GROUP BY a.i, b.j""")
def covariance_all(spark, sf):
    """Covariances of all components."""
    _, _, cov = pca.moments(t.vectors(spark, sf), "v")
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i long, j long, cov double").select("i", "j", r6(F.col("cov")).alias("cov"))


_COV = f"""{_V}, l AS (SELECT image_id, u.i AS i, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i)), m AS (SELECT i, avg(x) AS mean FROM l GROUP BY i)"""


@query(f"""WITH {_COV}, c AS (SELECT a.i AS i, b.j AS j, covar_samp(v[a.i], v[b.j]) AS cov FROM e, unnest(range(1, 65)) AS a(i), unnest(range(1, 65)) AS b(j) GROUP BY a.i, b.j)
SELECT round(pow(sum(cov) FILTER (WHERE i = j), 2) / sum(cov * cov), 6) AS effective_rank FROM c""")
def pca_effective_rank(spark, sf):
    """One over the sum of squared variance ratios, which the covariances give without their eigenvalues, too."""
    model = pca.fit(t.vectors(spark, sf), "v", 64)
    return pca.explained(spark, model).agg(r6(1 / F.sum(F.col("ratio") * F.col("ratio"))).alias("effective_rank"))


@query(f"WITH {_COV} SELECT image_id, round(sum((x - mean) * (x - mean)), 6) AS squared_norm, 0.0::DOUBLE AS rebuilt_error FROM l JOIN m USING (i) GROUP BY image_id")
def pca_norms(spark, sf):
    """All scores keep the distance from the mean, and lead back to the vector."""
    df = t.vectors(spark, sf)
    model = pca.fit(df, "v", 64)
    back = model.inverse(model.transform(df, "v", "scores", 64), "scores")
    return back.select("image_id", r6(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x)).alias("squared_norm"), r6(pixels.max_abs_error(F.col("rebuilt"), F.col("v"))).alias("rebuilt_error"))


def _fitted(spark, sf, k=18):
    train = splits.stratified_split(t.images(spark, sf), "image_id", "label")
    return train, pca.fit(train.where("split = 'train'"), "pixels", k)


@query()
def pca_explained(spark, sf):
    _, model = _fitted(spark, sf)
    return pca.explained(spark, model)


@query()
def pca_reconstruct_mse(spark, sf):
    """Noisy test images on the clean basis, and back."""
    df, model = _fitted(spark, sf)
    noisy = noise.speckle(df.where("split = 'test'"), "image_id", "pixels", 0.7, 44)
    back = model.inverse(model.transform(noisy, "noisy", "scores", 18), "scores")
    return back.select("image_id", F.size("scores").alias("k"), r6(pixels.squared_error(F.col("rebuilt"), F.col("pixels"))).alias("mse"))


@query(f"""WITH k AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY embedding[1], vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)
SELECT nth, image_id FROM range(10) AS r(nth) JOIN k ON pos = floor(nth * n / 10)""")
def evenly_spaced_ranks(spark, sf):
    df = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.get("embedding", 0).alias("x"))
    return splits.evenly_spaced(df, 10, "x", "image_id").select(F.col("nth").cast("long").alias("nth"), "image_id")


@query("SELECT label, vec_id AS image_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 11")
def nth_per_class(spark, sf):
    return splits.nth_of_class(t.vectors(spark, sf), 10, "label", "image_id").select("label", "image_id")


_MEANS = f"""WITH {_V}, l AS (SELECT image_id, label, u.i AS i, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i)), m AS (SELECT label AS class_id, i, avg(x) AS m FROM l GROUP BY label, i),
d AS (SELECT image_id, class_id, round(sum(x * m), 6) AS p FROM l JOIN m ON l.i = m.i GROUP BY image_id, class_id)"""


def _class_scores(spark, sf):
    """image_id, p: likeness to the mean of each class, in class order; ten means of 64 numbers."""
    df = t.vectors(spark, sf)
    means = df.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).orderBy("label", "i").collect()
    by: dict[int, list[float]] = {}
    for r in means:
        by.setdefault(r.label, []).append(r.m)
    likeness = lambda m: F.round(F.aggregate(F.zip_with("v", F.array(*map(F.lit, m)), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b), 6) + F.lit(0.0)
    return df.select("image_id", "label", F.array(*[likeness(by[k]) for k in sorted(by)]).alias("p"))


@query(f"{_MEANS} SELECT image_id, class_id::BIGINT AS class_id, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, class_id)::BIGINT AS rank, p = max(p) OVER (PARTITION BY image_id) AS is_top FROM d")
def ranked_classes(spark, sf):
    out = metrics.ranked_classes(_class_scores(spark, sf), "image_id", "p")
    return out.select("image_id", F.col("class_id").cast("long").alias("class_id"), F.col("rank").cast("long").alias("rank"), "is_top")


@query(f"{_MEANS} SELECT image_id, min(class_id)::BIGINT AS predicted FROM (SELECT *, max(p) OVER (PARTITION BY image_id) AS top FROM d) WHERE p = top GROUP BY image_id")
def argmax_class(spark, sf):
    return _class_scores(spark, sf).select("image_id", pixels.argmax(F.col("p")).cast("long").alias("predicted"))


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY quality, toxic")
def confusion_matrix(spark, sf):
    return metrics.confusion(t.table(spark, sf, "labels"), "quality", "toxic")


_IOU = """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY quality, toxic), k AS (SELECT a AS class FROM c UNION SELECT b FROM c),
s AS (SELECT class, coalesce(sum(n) FILTER (WHERE a = class AND b = class), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE a = class), 0)::BIGINT AS n_truth, coalesce(sum(n) FILTER (WHERE b = class), 0)::BIGINT AS n_predicted FROM k, c GROUP BY class)
"""


@query(_IOU + "SELECT class, tp, n_truth, n_predicted, round(tp / (n_truth + n_predicted - tp), 6) AS iou FROM s")
def iou_per_class(spark, sf):
    m = metrics.iou(metrics.confusion(t.table(spark, sf, "labels"), "quality", "toxic"))
    return m.select("class", F.col("tp").cast("long").alias("tp"), "n_truth", "n_predicted", r6(F.col("iou")).alias("iou"))


@query(_IOU + "SELECT round(avg(tp / (n_truth + n_predicted - tp)), 6) AS mean_iou FROM s")
def mean_iou(spark, sf):
    return metrics.mean_iou(metrics.confusion(t.table(spark, sf, "labels"), "quality", "toxic")).select(r6(F.col("mean_iou")).alias("mean_iou"))


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def accuracy(spark, sf):
    return metrics.accuracy(t.table(spark, sf, "labels"), "quality", "toxic").select(r6(F.col("accuracy")).alias("accuracy"))


@query(f"""WITH {_PROBS}, l AS (SELECT image, label, u.c, p[u.c + 1] AS p FROM q, unnest(range(0, 3)) AS u(c)),
s AS (SELECT image, c, sum(CASE WHEN label = c THEN p ELSE 0 END) AS i, sum((label = c)::INT + p) AS u FROM l GROUP BY image, c)
SELECT round(1 - avg((2 * i + 1e-6) / (u + 1e-6)), 6) AS dice_loss FROM s""")
def dice_loss(spark, sf):
    return metrics.dice_loss(t.probs(spark), "image", "label", "p").select(r6(F.col("dice_loss")).alias("dice_loss"))


@query(f"WITH {_PROBS} SELECT round(avg(-ln(greatest(p[label + 1], 1e-7))), 6) AS cross_entropy FROM q")
def cross_entropy(spark, sf):
    return metrics.cross_entropy(t.probs(spark), "label", "p").select(r6(F.col("cross_entropy")).alias("cross_entropy"))


@query("SELECT label, u.i - 1 AS class_id, (label = u.i - 1)::INT AS hot FROM (SELECT DISTINCT label FROM embeddings), unnest(range(1, 11)) AS u(i)")
def one_hot(spark, sf):
    df = t.table(spark, sf, "embeddings").select("label").distinct()
    return df.select("label", F.posexplode(pixels.one_hot(F.col("label"), 10)).alias("class_id", "hot")).select("label", F.col("class_id").cast("long").alias("class_id"), "hot")


@query(f"""WITH {_P}, c AS (SELECT image_id, y // 4 AS "by", x // 4 AS bx, least(floor(value * 7), 6)::INT AS class_id, count(*) AS n FROM p GROUP BY ALL)
SELECT image_id, "by"::INT AS "by", bx::INT AS bx, class_id FROM c QUALIFY row_number() OVER (PARTITION BY image_id, "by", bx ORDER BY n DESC, class_id) = 1""")
def majority_vote(spark, sf):
    long = tiles.long_form(t.class_ids(spark, sf), "classes", 8, ("image_id",)).withColumnRenamed("value", "class_id")
    return tiles.majority_vote(long, 4, "image_id")


@query(f"WITH {_P} SELECT image_id, (y // 4)::INT AS by, (x // 4)::INT AS bx, round(avg(value), 6) AS value FROM p GROUP BY image_id, y // 4, x // 4")
def box_downsample(spark, sf):
    return tiles.box_downsample(tiles.long_form(t.images(spark, sf), "pixels", 8, ("image_id",)), 4, 8, 8, "image_id", 6).withColumn("value", F.col("value") + F.lit(0.0))


@query(f"""WITH {_P} SELECT format('{{}}_{{:02d}}_{{:02d}}', image_id, y // 3, x // 3) AS name, (y // 3)::INT AS r, (x // 3)::INT AS c, count(*)::INT AS n, round(sum(value), 6) AS total
FROM p WHERE y < 6 AND x < 6 GROUP BY image_id, y // 3, x // 3""")
def grid_tiles(spark, sf):
    out = tiles.grid_tiles(t.images(spark, sf), "pixels", 8, 8, 3, "image_id")
    return out.select("name", "r", "c", F.size("tile").alias("n"), r6(F.aggregate("tile", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""WITH {_P} SELECT format('{{}}_{{:02d}}_{{:02d}}', image_id, r, c) AS name, r::INT AS r, c::INT AS c, count(*)::INT AS n, round(sum(value), 6) AS total
FROM p, range(2) AS a(r), range(2) AS b(c) WHERE y BETWEEN r * 3 AND r * 3 + 4 AND x BETWEEN c * 3 AND c * 3 + 4 GROUP BY image_id, r, c""")
def corner_tiles(spark, sf):
    out = tiles.corner_tiles(t.images(spark, sf), "pixels", 8, 8, 5, "image_id")
    return out.select("name", "r", "c", F.size("tile").alias("n"), r6(F.aggregate("tile", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '/([^/?]+)\.[a-z]+(?:\?.*)?$', 1) AS stem, replace(lower(url), '/', '_') AS flat FROM pages""")
def name_parse(spark, sf):
    url = F.col("url")
    return t.table(spark, sf, "pages").select("page_id", F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"/([^/?]+)\.[a-z]+(?:\?.*)?$", 1).alias("stem"), F.replace(F.lower(url), F.lit("/"), F.lit("_")).alias("flat"))


@query("""SELECT conv_id, turn, format('{}_{:02d}_{:02d}', conv_id, turn // 10, turn % 10) AS name, conv_id::VARCHAR AS img_id, (turn // 10)::INT AS r, (turn % 10)::INT AS c, conv_id || '_' || lpad((turn // 10)::VARCHAR, 2, '0') AS legacy_group FROM conversations""")
def tile_names(spark, sf):
    """Names of tiles, their parts, and the group that stripping two parts of the stem gives (which keeps the tile's row)."""
    df = t.table(spark, sf, "conversations").withColumn("name", names.tile_name(F.col("conv_id").cast("string"), F.floor(F.col("turn") / 10), F.col("turn") % 10))
    return df.select("conv_id", "turn", "name", names.tile_parts(F.col("name")).alias("t"), names.group_of(F.concat("name", F.lit("_sat.npy")), legacy=True).alias("legacy_group")).select("conv_id", "turn", "name", "t.*", "legacy_group")


_MODELS = f"""WITH {_P}, x AS (SELECT image_id, 'plus' AS model, greatest(0.0, least(1.0, value + 0.1::DOUBLE)) AS v, value FROM p UNION ALL SELECT image_id, 'half', value * 0.5::DOUBLE, value FROM p),
m AS (SELECT model, avg(e) AS mse FROM (SELECT model, image_id, avg((v - value) * (v - value)) AS e FROM x GROUP BY model, image_id) GROUP BY model)"""


def _models(spark, sf):
    df = t.images(spark, sf)
    return df.withColumn("plus", F.transform("pixels", lambda x: x + F.lit(0.1))).withColumn("half", F.transform("pixels", lambda x: x * F.lit(0.5)))


@query(f"{_MODELS} SELECT model, round(mse, 6) AS mse FROM m UNION ALL SELECT 'clean', 0.0")
def mse_by_model(spark, sf):
    return metrics.evaluate(_models(spark, sf), "pixels", {"plus": "plus", "half": "half"}, 8, 8, with_ssim=False).select("model", r6(F.col("mse")).alias("mse"))


@query(f"""{_MODELS}, d AS (SELECT max(mse) FILTER (WHERE model = 'half') - max(mse) FILTER (WHERE model = 'plus') AS difference FROM m)
SELECT 'half' AS model, 'plus' AS base, 'mse' AS metric, round(difference, 6) AS difference, CASE WHEN difference = 0 THEN 'same' WHEN difference < 0 THEN 'better' ELSE 'worse' END AS verdict FROM d""")
def metric_delta(spark, sf):
    scores = metrics.evaluate(_models(spark, sf), "pixels", {"plus": "plus", "half": "half"}, 8, 8, with_ssim=False)
    return metrics.delta(scores, "half", "plus", "mse").withColumn("difference", r6(F.col("difference")))


@query(f"""{_MODELS}, w AS (SELECT model, image_id, max(abs(v - value)) AS e FROM x GROUP BY model, image_id) SELECT model, round(max(e), 6) AS max_abs_error, max(e) < 5e-3 AS agrees FROM w GROUP BY model""")
def max_abs_error(spark, sf):
    df = _models(spark, sf).select("pixels", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.transform(m, pixels.clip01).alias("v")) for m in ("plus", "half")])).alias("e"))
    worst = df.groupBy("e.model").agg(F.max(pixels.max_abs_error(F.col("e.v"), F.col("pixels"))).alias("w"))
    return worst.select("model", r6(F.col("w")).alias("max_abs_error"), (F.col("w") < 5e-3).alias("agrees"))


def _at(dy: int, dx: int) -> str:
    return f"px[greatest(0, least(7, i // 8 + {dy})) * 8 + greatest(0, least(7, i % 8 + {dx})) + 1]"


_GX = f"({_at(-1, 1)} - {_at(-1, -1)} + 2 * ({_at(0, 1)} - {_at(0, -1)}) + {_at(1, 1)} - {_at(1, -1)})"
_GY = f"({_at(1, -1)} - {_at(-1, -1)} + 2 * ({_at(1, 0)} - {_at(-1, 0)}) + {_at(1, 1)} - {_at(-1, 1)})"


@query(f"WITH {_I}, g AS (SELECT image_id, {_GX} * {_GX} + {_GY} * {_GY} AS g FROM img, unnest(range(0, 64)) AS u(i)) SELECT image_id, round(avg(CASE WHEN sqrt(g) > 0.05 THEN g ELSE 0 END), 6) AS teng FROM g GROUP BY image_id")
def teng_2d(spark, sf):
    return t.images(spark, sf).select("image_id", r6(pixels.teng(F.col("pixels"), 8, 8)).alias("teng"))


def _noisy16(spark) -> DataFrame:
    """Made-up images, and under errors by an integer rule."""
    eps = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: ((F.col("image_id") * 7 + k * 5) % 21 - 10) / F.lit(10.0))
    return t.images16(spark).withColumn("noisy", noise.apply_eps(F.col("pixels"), eps))


_N16 = """r16 AS (SELECT i AS image_id, k, ((i * 31 + (k // 16) * 7 + (k % 16) * 13) % 256) / 255.0::DOUBLE AS t, ((i * 7 + k * 5) % 21 - 10) / 10.0::DOUBLE AS eps FROM range(100) AS a(i), range(256) AS b(k)),
s16 AS (SELECT image_id, k, k // 16 AS y, k % 16 AS x, t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, t * (1 + eps))) AS v FROM r16),
gw AS (SELECT d, exp(-pow(d - 5, 2) / 4.5::DOUBLE) / sum(exp(-pow(d - 5, 2) / 4.5::DOUBLE)) OVER () AS g FROM range(11) AS r(d)),
win AS (SELECT image_id, sum(p.g * q.g * v) AS ma, sum(p.g * q.g * t) AS mb, sum(p.g * q.g * v * v) AS aa, sum(p.g * q.g * t * t) AS bb, sum(p.g * q.g * v * t) AS ab
        FROM range(6) AS wy(oy), range(6) AS wx(ox), gw p, gw q, s16 WHERE y = oy + p.d AND x = ox + q.d GROUP BY image_id, oy, ox),
sim AS (SELECT image_id, avg(((2 * ma * mb + 1e-4::DOUBLE) * (2 * (ab - ma * mb) + 9e-4::DOUBLE)) / ((ma * ma + mb * mb + 1e-4::DOUBLE) * (aa - ma * ma + bb - mb * mb + 9e-4::DOUBLE))) AS s FROM win GROUP BY image_id)"""


def _at16(dy: int, dx: int) -> str:
    return f"px[greatest(0, least(15, i // 16 + {dy})) * 16 + greatest(0, least(15, i % 16 + {dx})) + 1]"


_GX16 = f"({_at16(-1, 1)} - {_at16(-1, -1)} + 2 * ({_at16(0, 1)} - {_at16(0, -1)}) + {_at16(1, 1)} - {_at16(1, -1)})"
_GY16 = f"({_at16(1, -1)} - {_at16(-1, -1)} + 2 * ({_at16(1, 0)} - {_at16(-1, 0)}) + {_at16(1, 1)} - {_at16(-1, 1)})"


@query(f"WITH {_N16} SELECT image_id, 1.0::DOUBLE AS same, round(s, 6) AS noisy FROM sim")
def ssim(spark, sf):
    """Made-up images against themselves and against noisy ones."""
    df = _noisy16(spark)
    return df.select("image_id", r6(metrics.ssim(F.col("pixels"), F.col("pixels"), 16, 16)).alias("same"), r6(metrics.ssim(F.col("noisy"), F.col("pixels"), 16, 16)).alias("noisy"))


@query(f"""WITH {_N16}, both16 AS (SELECT 'clean' AS model, image_id, k, t AS v, t FROM s16 UNION ALL SELECT 'noisy input', image_id, k, v, t FROM s16),
l16 AS (SELECT model, image_id, list(v ORDER BY k) AS px, avg((v - t) * (v - t)) AS mse FROM both16 GROUP BY model, image_id),
g16 AS (SELECT model, image_id, {_GX16} * {_GX16} + {_GY16} * {_GY16} AS g FROM l16, unnest(range(0, 256)) AS u(i)),
t16 AS (SELECT model, image_id, avg(CASE WHEN sqrt(g) > 0.05 THEN g ELSE 0 END) AS teng FROM g16 GROUP BY model, image_id)
SELECT model, round(avg(mse), 6) AS mse, round(avg(CASE WHEN model = 'clean' THEN 1 ELSE s END), 6) AS ssim, round(avg(teng), 6) AS teng FROM l16 JOIN t16 USING (model, image_id) JOIN sim USING (image_id) GROUP BY model""")
def evaluate_models(spark, sf):
    scores = metrics.evaluate(_noisy16(spark), "pixels", {"noisy input": "noisy"}, 16, 16)
    return scores.select("model", *[r6(F.col(c)).alias(c) for c in ("mse", "ssim", "teng")])


@query()
def reservoir_embed(spark, sf):
    """Six leading scores, scaled, through a chain of six atoms."""
    df = t.images(spark, sf)
    scores = pca.fit(df, "pixels", 6).transform(df, "pixels")
    scaled = scaling.minmax(scores, "scores", scaling.column_stats(scores, "scores"))
    return reservoir.reservoir(scaled.select("image_id", "scaled"), "scaled", "embedding", reservoir.Config(atoms=6)).select("image_id", "embedding")


@query()
def reservoir_class_means(spark, sf):
    """The mean image of each class, on 18 scaled scores, through the full chain of 18 atoms."""
    df = t.images(spark, sf)
    pixel = F.posexplode("pixels").alias("k", "x")
    means = df.select("label", pixel).groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("pixels"))
    model = pca.fit(df, "pixels", 18)
    scaled = scaling.minmax(model.transform(means, "pixels"), "scores", scaling.column_stats(model.transform(df, "pixels"), "scores"))
    return reservoir.reservoir(scaled.select("label", "scaled").repartition(10, "label"), "scaled", "embedding").select("label", "embedding")


@query("SELECT a.i::INT AS i, b.j::INT AS j FROM range(18) AS a(i), range(18) AS b(j) WHERE a.i < b.j")
def qubit_pairs(spark, sf):
    return tiles.qubit_pairs(spark, 18)


def rule_net(inputs: int, hidden: int, outputs: int) -> nets.Dense:
    """Two layers whose weights an integer rule gives."""
    i, j, k = np.arange(inputs)[:, None], np.arange(hidden), np.arange(outputs)
    return nets.Dense([((i * 7 + j * 13) % 11 - 5) / 40, ((j[:, None] * 5 + k * 3) % 13 - 6) / 40], [((j * 3) % 5 - 2) / 10, ((k * 7) % 3 - 1) / 10])


_W1, _B1, _W2, _B2 = "((i * 7 + j * 13) % 11 - 5) / 40.0::DOUBLE", "((j * 3) % 5 - 2) / 10.0::DOUBLE", "((j * 5 + k * 3) % 13 - 6) / 40.0::DOUBLE", "((k * 7) % 3 - 1) / 10.0::DOUBLE"
#: Both layers' outputs h and o of rows x(n, i, v).
_NET = f"""h AS (SELECT n, j, greatest(0.0::DOUBLE, sum(v * {_W1}) + {_B1}) AS h FROM x, range(32) AS a(j) GROUP BY n, j),
o AS (SELECT n, k, 1 / (1 + exp(-(sum(h * {_W2}) + {_B2}))) AS o FROM h, range(64) AS b(k) GROUP BY n, k)"""


@query(f"""WITH {_P}, x AS (SELECT image_id AS n, i, value AS v FROM p), {_NET}
SELECT n AS image_id, round(avg((o - v) * (o - v)), 6) AS mse FROM o JOIN x USING (n) WHERE k = i GROUP BY n""")
def mlp_score(spark, sf):
    """A fixed dense network over pixels, and its error."""
    out = rule_net(64, 32, 64).score(t.images(spark, sf), "pixels")
    return out.select("image_id", r6(pixels.squared_error(F.col("rebuilt"), F.col("pixels"))).alias("mse"))


@query()
def cnn_score(spark, sf):
    """Class probabilities of 8 x 8 images by a fixed convolutional network."""
    df = t.images(spark, sf).withColumn("rgb", pixels.replicate(F.col("pixels")))
    net = nets.ConvNet.create(8, (4, 8), 16, 10, 3)
    return net.score(df, "rgb").select("image_id", pixels.argmax(F.col("probs")).alias("predicted"))


@query(f"""WITH {_HISTORY}, b AS (SELECT *, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h),
l AS (SELECT *, max(CASE WHEN m IS NULL OR val_loss < m THEN epoch END) OVER (ORDER BY epoch) AS lb FROM b), s AS (SELECT min(epoch) FILTER (WHERE epoch - lb >= 20) AS stopped_at FROM l)
SELECT 'run' AS run_id, stopped_at, max(lb) AS restored FROM l, s WHERE stopped_at IS NULL OR epoch <= stopped_at GROUP BY stopped_at""")
def early_stop(spark, sf):
    return hist.early_stop(t.history(spark), "val_loss", 20)


@query(f"WITH {_HISTORY} SELECT run_id, epoch, round(val_loss, 6) AS val_loss FROM h ORDER BY val_loss, epoch LIMIT 1")
def best_epoch(spark, sf):
    return hist.best_epoch(t.history(spark), "val_loss").withColumn("val_loss", r6(F.col("val_loss")))


@query(f"""WITH {_HISTORY}, b AS (SELECT *, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h),
l AS (SELECT *, max(CASE WHEN m IS NULL OR val_loss < m THEN epoch END) OVER (ORDER BY epoch) AS lb FROM b)
SELECT epoch, round(greatest(1e-4 * pow(0.5, sum((epoch > lb AND (epoch - lb) % 5 = 0)::INT) OVER (ORDER BY epoch)), 1e-7), 9) AS lr FROM l""")
def lr_plateau(spark, sf):
    return hist.lr_plateau(t.history(spark), "val_loss", 1e-4).select("epoch", F.round("lr", 9).alias("lr"))


@query("""WITH k AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, ceil(count(*) OVER () / 8.0) AS nb FROM embeddings)
SELECT image_id, pos // 8 AS batch FROM k WHERE (pos // 8) % greatest(1, floor(nb / 10))::BIGINT = 0 AND pos // 8 < greatest(1, floor(nb / 10))::BIGINT * 10""")
def every_kth(spark, sf):
    return splits.every_kth(t.vectors(spark, sf).select("image_id"), 8, 10, "image_id").select("image_id", "batch")


@query(f"SELECT vec_id AS image_id FROM embeddings ORDER BY {_SHUFFLE} LIMIT 20")
def sample_n(spark, sf):
    return splits.sample_n(t.vectors(spark, sf), 20, "image_id", 42).select("image_id")


@query("SELECT vec_id AS image_id FROM embeddings ORDER BY vec_id LIMIT 20")
def first_n(spark, sf):
    return splits.first_n(t.vectors(spark, sf), 20, "image_id").select("image_id")


@query("SELECT vec_id AS image_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings QUALIFY pos IN (1, 2, 4)")
def at_positions(spark, sf):
    return splits.at_positions(t.vectors(spark, sf).select("image_id"), [1, 2, 4], "image_id")


@query("SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch, vec_id AS image_id FROM embeddings")
def batches(spark, sf):
    return splits.batches(t.vectors(spark, sf).select("image_id"), 32, "image_id").select("batch", "image_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tick, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def tick_format(spark, sf):
    return t.table(spark, sf, "events").select("event_id", names.tick(F.col("ts")).alias("tick"), names.run_stamp(F.col("ts")).alias("stamp"))


@query(f"""WITH x AS (SELECT n, i, (n * 5 + i * 3) % 7 / 7.0::DOUBLE AS v FROM range(16) AS a(n), range(18) AS b(i)), {_NET},
d AS (SELECT n, k, 2 * (o - (n * 3 + k * 11) % 9 / 9.0::DOUBLE) / (16 * 64) * o * (1 - o) AS d FROM o),
c AS (SELECT n, j, sum(d * {_W2}) * (max(h) > 0)::INT AS c FROM d JOIN h USING (n) GROUP BY n, j),
g AS (SELECT 'dense_1' AS layer, 'kernel' AS kind, sum(h * d) AS g FROM h JOIN d USING (n) GROUP BY j, k UNION ALL SELECT 'dense_1', 'bias', sum(d) FROM d GROUP BY k
  UNION ALL SELECT 'dense_0', 'kernel', sum(v * c) FROM x JOIN c USING (n) GROUP BY i, j UNION ALL SELECT 'dense_0', 'bias', sum(c) FROM c GROUP BY j)
SELECT layer, kind, round(sqrt(sum(g * g)), 6) AS grad_norm FROM g GROUP BY layer, kind""")
def gradient_norms(spark, sf):
    """L2 norms of a dense network's gradients by layer and kind."""
    n, i, k = np.arange(16)[:, None], np.arange(18), np.arange(64)
    rows = rule_net(18, 32, 64).gradient_norms((n * 5 + i * 3) % 7 / 7, (n * 3 + k * 11) % 9 / 9)
    return spark.createDataFrame(rows, "layer string, kind string, grad_norm double").withColumn("grad_norm", r6(F.col("grad_norm")))


_LAYERS = """l(model, layer, conv, a, b) AS (VALUES ('digits', 'dense_0', false, 18, 1024), ('digits', 'dense_1', false, 1024, 512), ('digits', 'dense_2', false, 512, 784),
('vgg', 'conv_0', true, 3, 32), ('vgg', 'conv_1', true, 32, 32), ('vgg', 'conv_2', true, 32, 64), ('vgg', 'conv_3', true, 64, 64), ('vgg', 'conv_4', true, 64, 128), ('vgg', 'conv_5', true, 128, 128),
('vgg', 'dense_0', false, 8 * 8 * 128, 128), ('vgg', 'dense_1', false, 128, 10)),
n AS (SELECT *, (CASE WHEN conv THEN 9 * a * b + b ELSE a * b + b END)::BIGINT AS parameters FROM l)"""


@query(f"WITH {_LAYERS} SELECT model, layer, a::BIGINT AS inputs, b::BIGINT AS outputs, parameters FROM n")
def net_summary(spark, sf):
    """Layers, widths and parameters of both networks."""
    made = {"digits": nets.Dense.create([18, *nets.DIGITS]), "vgg": nets.ConvNet.create()}
    return spark.createDataFrame([(m, *row) for m, net in made.items() for row in net.summary()], "model string, layer string, inputs long, outputs long, parameters long")


@query(f"""WITH {_PROBS}, l AS (SELECT image, label, u.c, p[u.c + 1] AS p FROM q, unnest(range(0, 3)) AS u(c)),
s AS (SELECT image, c, sum(CASE WHEN label = c THEN p ELSE 0 END) AS i, sum((label = c)::INT + p) AS u FROM l GROUP BY image, c)
SELECT round((SELECT 1 - avg((2 * i + 1e-6) / (u + 1e-6)) FROM s) + (SELECT avg(-ln(greatest(p[label + 1], 1e-7))) FROM q), 6) AS loss""")
def segmentation_loss(spark, sf):
    """Cross-entropy and Dice loss added."""
    return metrics.segmentation_loss(t.probs(spark), "image", "label", "p").select(r6(F.col("loss")).alias("loss"))


@query("SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    """The windows of the stream of events, as a batch."""
    out = ticks.windowed_counts(t.table(spark, sf, "events"), "ts", "event_type")
    return out.select(names.tick(F.col("start")).alias("start"), "event_type", F.col("count").alias("n"))


@query(f"WITH {_P} SELECT image_id, true AS aligned, sum(least(floor(value * 7), 6))::BIGINT AS total FROM p GROUP BY image_id")
def augment_joint(spark, sf):
    """Class masks and images that show them, turned and flipped: both stay alike, and no pixel is lost."""
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    packed = lambda times: F.unhex(F.array_join(F.transform("classes", lambda c: F.repeat(byte(c), times)), ""))
    df = t.class_ids(spark, sf).select("image_id", packed(3).alias("image"), packed(1).alias("mask"))
    out = noise.augment(df, "image_id", "image", "mask", 8, epoch=1).select("image_id", F.hex("image").alias("image"), F.hex("mask").alias("mask"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda a, i: a + F.substring(F.col("mask"), 2 * i, F.lit(1)).cast("long"))
    return out.select("image_id", (F.regexp_replace("mask", "(..)", "$1$1$1") == F.col("image")).alias("aligned"), total.alias("total"))


@query("SELECT vec_id AS image_id, row_number() OVER (ORDER BY md5(vec_id || ':42000129'), vec_id) AS pos FROM embeddings")
def epoch_shuffle(spark, sf):
    """Places in the order of the third epoch."""
    return ranking.shuffled_rank(t.vectors(spark, sf).select("image_id"), "image_id", splits.epoch_seed(42, 3), name="pos")


@query(f"WITH {_V} SELECT image_id, 100 AS width, round(list_sum(v[1:18]), 6) AS total, 82 AS zeros FROM e")
def head_padded(spark, sf):
    """18 components and zeros up to 100."""
    df = t.vectors(spark, sf).select("image_id", pixels.head_padded(F.col("v"), 18, 100).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return df.select("image_id", F.size("p").alias("width"), r6(total).alias("total"), F.size(F.filter("p", lambda x: x == 0)).alias("zeros"))


@query(f"WITH {_V}, l AS (SELECT image_id, (u.i - 1) // 8 AS y, v[u.i] AS x FROM e, unnest(range(1, 65)) AS u(i)) SELECT image_id, y, round(sum(greatest(0, least(1, x))), 6) AS total, count(*) AS width FROM l GROUP BY image_id, y")
def image_rows(spark, sf):
    """Flat vectors as rows of pixels, cut to 0..1."""
    rows = t.vectors(spark, sf).select("image_id", F.posexplode(pixels.to_rows(F.col("v"), 8)).alias("y", "row"))
    return rows.select("image_id", F.col("y").cast("long").alias("y"), r6(F.aggregate("row", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("row").cast("long").alias("width"))


@query(f"WITH {_LAYERS} SELECT model, sum(parameters)::BIGINT AS parameters FROM n GROUP BY model")
def parameter_counts(spark, sf):
    sizes = [18, *nets.DIGITS]
    digits = sum(a * b + b for a, b in zip(sizes, sizes[1:], strict=False))
    return spark.createDataFrame([("digits", digits), ("vgg", nets.ConvNet.create().parameters())], "model string, parameters long")


