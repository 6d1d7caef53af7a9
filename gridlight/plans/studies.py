"""The three studies from raw images to result tables: denoising, tiling for segmentation, classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.functions import pixels
from gridlight.functions.names import tile_name
from gridlight.operators import metrics, nets, noise, pca, reservoir, scaling, splits, tiles
from gridlight.operators.training import Rows
from gridlight.sources import images as image_sources


def denoise(images: DataFrame, height: int, width: int, cfg: reservoir.Config | None = None, sigma: float = 0.7, components: int = 100, hidden: tuple[int, ...] = nets.READOUT, seed: int = noise.SEED, batch: int = 64, **train) -> DataFrame:
    """model, mse, ssim, teng on the test split: clean, noisy, linear reconstruction, network on scores, network on the
    reservoir's features of the scores. images has image_id, label, pixels in 0..1; networks learn from the whole train split.
    ``train`` goes to Dense.fit_rows."""
    cfg = cfg or reservoir.Config()
    d = cfg.atoms
    parts = splits.stratified_split(images, "image_id", "label", seed=seed)
    noisy = noise.speckle(parts, "image_id", "pixels", sigma, noise.seed_of_split(F.col("split"), seed))
    model = pca.fit(noisy.where("split = 'train'"), "pixels", max(d, components))
    scored = model.transform(noisy, "noisy", "scores", d).persist()
    train_rows = scored.where("split = 'train'")
    scaled = scaling.minmax(scored, "scores", scaling.column_stats(train_rows, "scores"), "z")
    embedded = reservoir.reservoir(scaled, "z", "embedding", cfg).persist()
    done = embedded.where("split = 'test'")
    for source, out in (("embedding", "hybrid"), ("z", "baseline")):
        std = scaling.column_stats(embedded.where("split = 'train'"), source)
        ready = scaling.standardise(embedded, source, std, "x")
        part = lambda name: Rows(ready.where(F.col("split") == name).select("image_id", "x", "pixels"), "image_id", "x", "pixels", batch, seed)  # noqa: E731, B023
        net = nets.Dense.create([cfg.width if source == "embedding" else d, *hidden[:-1], height * width], seed).fit_rows(part("train"), part("val"), **train)
        done = net.score(scaling.standardise(done, source, std, "x"), "x", out).drop("x")
    done = model.inverse(done, "scores", "linear")
    return metrics.evaluate(done, "pixels", {"noisy": "noisy", "linear": "linear", "baseline": "baseline", "hybrid": "hybrid"}, height, width, with_ssim=min(height, width) >= 11)


def decode_mask(rgb: np.ndarray) -> np.ndarray:
    """Colours to classes; a colour that is not in the palette is class 0."""
    out = np.zeros(rgb.shape[:2], np.uint8)
    for cls, _, r, g, b in tiles.PALETTE:
        out[(rgb == (r, g, b)).all(-1)] = cls
    return out


def shrink(image: np.ndarray, mask: np.ndarray | None, factor: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Block means of the image, rounded, and the most frequent class of each block, the smallest of equals."""
    h, w = image.shape[0] // factor, image.shape[1] // factor
    blocks = image[: h * factor, : w * factor].reshape(h, factor, w, factor, 3)
    small = np.floor(blocks.mean(axis=(1, 3)) + 0.5).astype(np.uint8)
    if mask is None:
        return small, None
    votes = (mask[: h * factor, : w * factor].reshape(h, factor, w, factor, 1) == np.arange(len(tiles.PALETTE))).sum(axis=(1, 3))
    return small, votes.argmax(-1).astype(np.uint8)


def cut_pair(image: np.ndarray, mask: np.ndarray | None, size: int, grid: int, downsample: bool, factor: int = 4) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(r, c, tile of the image, tile of the mask): a grid, or the corners of the shrunken image."""
    if downsample:
        image, mask = shrink(image, mask, factor)
        tops, lefts = (0, image.shape[0] - size), (0, image.shape[1] - size)
    else:
        tops, lefts = ([k * size for k in range(min(grid, n // size))] for n in image.shape[:2])
    for r, y in enumerate(tops):
        for c, x in enumerate(lefts):
            yield r, c, image[y : y + size, x : x + size], None if mask is None else mask[y : y + size, x : x + size]


def prepare_tiles(pairs: DataFrame, size: int = 256, grid: int = 9, downsample: bool = False, share: float = 0.15, seed: int = noise.SEED) -> DataFrame:
    """img_id, split, resolution, r, c, name, sat, mask of images (img_id, h, w, rgb bytes, mask_rgb bytes or null); whole
    images go to one side of the split."""
    parts = splits.group_split(pairs, "img_id", share, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, s, h, w, rgb, m in zip(pdf.img_id, pdf.split, pdf.h, pdf.w, pdf.rgb, pdf.mask_rgb, strict=True):
                image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
                mask = None if m is None else decode_mask(np.frombuffer(m, np.uint8).reshape(h, w, 3))
                rows += [(i, s, "2m" if downsample else "0.5m", r, c, a.tobytes(), None if b is None else b.tobytes()) for r, c, a, b in cut_pair(image, mask, size, grid, downsample)]
            yield pd.DataFrame(rows, columns=["img_id", "split", "resolution", "r", "c", "sat", "mask"])

    out = parts.select("img_id", "split", "h", "w", "rgb", "mask_rgb").mapInPandas(run, "img_id string, split string, resolution string, r int, c int, sat binary, mask binary")
    return out.withColumn("name", tile_name(F.col("img_id"), F.col("r"), F.col("c")))


def tile_counts(tiles_table: DataFrame, per_image: int) -> DataFrame:
    """split, n_images, n_tiles, n_pairs, complete: are all tiles there?"""
    have = tiles_table.groupBy("split").agg(F.countDistinct("img_id").alias("n_images"), F.count("*").alias("n_tiles"), F.count("mask").alias("n_pairs"))
    return have.withColumn("complete", F.col("n_tiles") == F.col("n_images") * per_image)


def score_segmentation(tiles_table: DataFrame, predict, classes: int = len(tiles.PALETTE)) -> DataFrame:
    """truth, predicted, n over all pixels of all pairs; predict maps a list of image bytes to arrays of class ids. One row for
    each pair of classes leaves a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(classes * classes, np.int64)
        for pdf in batches:
            for m, p in zip(pdf["mask"], predict(list(pdf.sat)), strict=True):
                total += np.bincount(np.frombuffer(m, np.uint8).astype(np.int64) * classes + np.asarray(p).ravel(), minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"truth": at // classes, "predicted": at % classes, "n": total[at]})

    part = tiles_table.where("mask IS NOT NULL").select("sat", "mask").mapInPandas(run, "truth int, predicted int, n long")
    return part.groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def digits(images: DataFrame, tests: DataFrame, side: int = 28, sigma: float = 0.7, components: int = 18, hidden: tuple[int, ...] = nets.DIGITS, share: float = 0.2, seed: int = noise.SEED, batch: int = 64, rate: float = 1e-3, **train) -> tuple[DataFrame, nets.Dense]:
    """model, mse, ssim, teng on the test images, and the network: noisy, linear reconstruction, network on the scores of the noisy
    image. images and tests have image_id, label, pixels in 0..1; a stratified share of images is for validation."""
    parts = splits.train_test_split(images, "image_id", "label", share, seed).withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    model = pca.fit(parts.where("split = 'train'"), "pixels", components)
    noisy = lambda df, k: noise.speckle(df, "image_id", "pixels", sigma, k)
    scored = model.transform(noisy(parts, noise.seed_of_split(F.col("split"), seed)), "noisy", "scores").persist()
    part = lambda name: Rows(scored.where(F.col("split") == name).select("image_id", "scores", "pixels"), "image_id", "scores", "pixels", batch, seed)
    net = nets.Dense.create([components, *hidden[:-1], side * side], seed).fit_rows(part("train"), part("val"), rate, **train)
    scored.unpersist()
    done = net.score(model.inverse(model.transform(noisy(tests, seed + 2), "noisy", "scores"), "scores", "linear"), "scores", "network")
    return metrics.evaluate(done, "pixels", {"noisy": "noisy", "linear": "linear", "network": "network"}, side, side, with_ssim=side >= 11), net


def unpacked_tiles(tiles_table: DataFrame, side: int, seed: int = noise.SEED):
    """What Rows.prepare needs for tiles: RGB in 0..1 as x and classes as y; in training, turned, flipped and jittered anew each epoch."""

    def prepare(df: DataFrame, epoch: int | None) -> DataFrame:
        turned = df if epoch is None else noise.augment(df, "name", "sat", "mask", side, seed, epoch, jitter=True)
        return image_sources.unpack(image_sources.unpack(turned, "sat", "x"), "mask", "y").withColumn("y", F.transform("y", lambda v: F.round(v * 255)))

    return prepare


def train_segmentation(tiles_table: DataFrame, net: nets.SegNet, batch: int = 8, seed: int = noise.SEED, **train) -> nets.SegNet:
    """net trained on the pairs of the train split (img_id, r, c, name, split, sat, mask), measured on those of the val split."""
    pairs = tiles_table.where("mask IS NOT NULL").select("name", "split", "sat", "mask")
    part = lambda name: Rows(pairs.where(F.col("split") == name), "name", "x", "y", batch, seed, unpacked_tiles(pairs, net.side, seed))
    return net.fit_rows(part("train"), part("val"), **train)


def train_classifier(images: DataFrame, net: nets.ConvNet, epochs: int = 5, batch: int = 32, share: float = 0.2, optimizer: str = "rmsprop", seed: int = noise.SEED, **train) -> nets.ConvNet:
    """net trained on the train split of images (image_id, label, values in 0..1), measured on the rest after each epoch."""
    parts = splits.train_test_split(images, "image_id", "label", share, seed)
    part = lambda name: Rows(parts.where(F.col("split") == name).select("image_id", "values", "label"), "image_id", "values", "label", batch, seed)
    return net.fit_rows(part("train"), part("test"), epochs, optimizer, **train)


def classify(images: DataFrame, net: nets.ConvNet, share: float = 0.2, seed: int = noise.SEED) -> tuple[DataFrame, DataFrame]:
    """Scores of the held-out split (image_id, label, probs, predicted), and their accuracy; images has values in 0..1."""
    held = splits.train_test_split(images, "image_id", "label", share, seed).where("split = 'test'")
    scored = net.score(held, "values", "probs").withColumn("predicted", pixels.argmax(F.col("probs")))
    return scored, metrics.accuracy(scored, "label", "predicted")
