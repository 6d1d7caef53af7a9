"""Scores of rebuilt images and of segmentations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlight.functions.pixels import as_doubles, clip01, squared_error, teng


def gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def ssim_images(a: np.ndarray, b: np.ndarray, top: float = 1.0) -> np.ndarray:
    """Structural similarity per image (n, h, w): Gaussian window of 11 and 1.5, K1 0.01, K2 0.03, no padding."""
    g = gaussian()

    def blur(x: np.ndarray) -> np.ndarray:
        x = np.einsum("nhwk,k->nhw", np.lib.stride_tricks.sliding_window_view(x, len(g), axis=2), g)
        return np.einsum("nhwk,k->nhw", np.lib.stride_tricks.sliding_window_view(x, len(g), axis=1), g)

    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, ab = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    return (((2 * ma * mb + c1) * (2 * ab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(axis=(1, 2))


def ssim(a: Column, b: Column, height: int, width: int) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        stack = lambda s: np.stack([np.asarray(v, float).reshape(height, width) for v in s])
        return pd.Series(ssim_images(stack(x), stack(y)))

    return score(as_doubles(a), as_doubles(b))


def teng_stack(x: np.ndarray, threshold: float = 0.05) -> float:
    """The sharpness of a stack of images taken as one solid: smoothing runs over neighbouring images, too."""
    pad = np.pad(x, 1, mode="symmetric")

    def sobel(axis: int) -> np.ndarray:
        out = pad
        for k in range(3):
            lo, mid, hi = (np.take(out, range(s, out.shape[k] - 2 + s), axis=k) for s in range(3))
            out = hi - lo if k == axis else lo + 2 * mid + hi
        return out

    g = np.sqrt(sobel(1) ** 2 + sobel(2) ** 2)
    return float(np.where(g > threshold, g * g, 0).mean())


def evaluate(df: DataFrame, truth: str, models: dict[str, str], height: int, width: int, with_ssim: bool = True) -> DataFrame:
    """model, mse, ssim, teng per rebuilt column, and the clean images' own row (0, 1, sharpness)."""
    entries = [F.struct(F.lit(m).alias("model"), F.transform(as_doubles(F.col(c)), clip01).alias("v")) for m, c in models.items()]
    clean = as_doubles(F.col(truth))
    long = df.select(clean.alias("t"), F.explode(F.array(F.struct(F.lit("clean").alias("model"), clean.alias("v")), *entries)).alias("e")).select("t", "e.model", "e.v")
    similar = ssim(F.col("v"), F.col("t"), height, width) if with_ssim else F.lit(None).cast("double")
    return long.groupBy("model").agg(F.avg(squared_error(F.col("v"), F.col("t"))).alias("mse"), F.avg(similar).alias("ssim"), F.avg(teng(F.col("v"), height, width)).alias("teng"))


def delta(scores: DataFrame, model: str, base: str, metric: str, lower_is_better: bool = True) -> DataFrame:
    """model, base, metric, difference and whether that is better."""
    gap = F.max(F.when(F.col("model") == model, F.col(metric))) - F.max(F.when(F.col("model") == base, F.col(metric)))
    out = scores.agg(gap.alias("difference"))
    good = F.col("difference") < 0 if lower_is_better else F.col("difference") > 0
    verdict = F.when(F.col("difference") == 0, "same").when(good, "better").otherwise("worse")
    return out.select(F.lit(model).alias("model"), F.lit(base).alias("base"), F.lit(metric).alias("metric"), "difference", verdict.alias("verdict"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n: partial counts per task, at most classes ** 2 rows."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def iou(matrix: DataFrame) -> DataFrame:
    """class, tp, n_truth, n_predicted, iou of a confusion matrix."""
    sides = F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"))))
    hits = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    long = matrix.select(hits.alias("hit"), sides.alias("s")).select("s.*", F.when(F.col("s.t") > 0, F.col("hit")).otherwise(0).alias("hit"))
    out = long.groupBy("class").agg(F.sum("hit").alias("tp"), F.sum("t").alias("n_truth"), F.sum("p").alias("n_predicted"))
    return out.withColumn("iou", F.col("tp") / (F.col("n_truth") + F.col("n_predicted") - F.col("tp")))


def mean_iou(matrix: DataFrame) -> DataFrame:
    """Mean over the classes that occur."""
    return iou(matrix).agg(F.avg("iou").alias("mean_iou"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def dice_loss(pixels: DataFrame, image: str, label: str, probs: str, smooth: float = 1e-6) -> DataFrame:
    """1 - mean over images and all classes of (2 I + s) / (U + s)."""
    long = pixels.select(image, label, F.posexplode(probs).alias("class", "p"))
    hit = (F.col(label) == F.col("class")).cast("double")
    by = long.groupBy(image, "class").agg(F.sum(hit * F.col("p")).alias("i"), F.sum(hit + F.col("p")).alias("u"))
    return by.agg((1 - F.avg((2 * F.col("i") + smooth) / (F.col("u") + smooth))).alias("dice_loss"))


def cross_entropy(pixels: DataFrame, label: str, probs: str, floor: float = 1e-7) -> DataFrame:
    return pixels.agg(F.avg(-F.log(F.greatest(F.get(F.col(probs), F.col(label)), F.lit(floor)))).alias("cross_entropy"))


def segmentation_loss(pixels: DataFrame, image: str, label: str, probs: str) -> DataFrame:
    """loss: cross-entropy plus Dice loss, what segmentation networks are trained on."""
    return cross_entropy(pixels, label, probs).union(dice_loss(pixels, image, label, probs)).agg(F.sum("cross_entropy").alias("loss"))


def ranked_classes(df: DataFrame, key: str, probs: str) -> DataFrame:
    """key, class_id, p, rank (by p, ties by class) and is_top (all classes of the highest p)."""
    long = df.select(key, F.posexplode(probs).alias("class_id", "p"))
    by = Window.partitionBy(key)
    return long.withColumn("rank", F.row_number().over(by.orderBy(F.desc("p"), "class_id"))).withColumn("is_top", F.col("p") == F.max("p").over(by))
