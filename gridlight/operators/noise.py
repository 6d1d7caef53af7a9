"""Seeded speckle noise and joint augmentation, keyed by the image id."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.functions.pixels import as_doubles, clip01

SEED = 42


def generator(seed: int, key) -> np.random.Generator:
    """A random stream of its own for each image, whatever partition it is in."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little"))


def apply_eps(v: Column, eps: Column) -> Column:
    """x * (1 + eps), cut to 0..1."""
    return F.zip_with(v, eps, lambda x, e: clip01(x * (1 + e)))


def speckle(df: DataFrame, key: str, vector: str, sigma: float, seed: Column | int = SEED, out: str = "noisy") -> DataFrame:
    """df with the vector under multiplicative normal noise; rows of equal seed and key get equal noise."""

    @F.pandas_udf("array<double>")
    def noisy(keys: pd.Series, seeds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([np.clip(np.asarray(v, float) * (1 + generator(s, k).normal(0, sigma, len(v)).astype(np.float32)), 0, 1) for k, s, v in zip(keys, seeds, values, strict=True)], dtype=object)

    return df.withColumn(out, noisy(F.col(key).cast("string"), seed if isinstance(seed, Column) else F.lit(seed), as_doubles(F.col(vector))))


def seed_of_split(split: Column, seed: int = SEED) -> Column:
    """train: seed, val: seed + 1, test: seed + 2."""
    return F.when(split == "train", seed).when(split == "val", seed + 1).otherwise(seed + 2)


def augment_arrays(image: np.ndarray, mask: np.ndarray, rng: np.random.Generator, jitter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Flips and quarter turns of both; brightness, contrast, saturation and hue of the image alone."""
    if rng.random() < 0.5:
        image, mask = image[:, ::-1], mask[:, ::-1]
    if rng.random() < 0.5:
        image, mask = image[::-1], mask[::-1]
    turns = int(rng.integers(4))
    image, mask = np.rot90(image, turns), np.rot90(mask, turns)
    if jitter:
        x = image.astype(float) / 255 + rng.uniform(-0.2, 0.2)
        x = (x - x.mean(axis=(0, 1))) * rng.uniform(0.8, 1.2) + x.mean(axis=(0, 1))
        # saturation and hue in luma-chroma form: chroma is stretched and turned
        y = x @ np.array([0.299, 0.587, 0.114])
        u, v = (x[..., 2] - y) * 0.492, (x[..., 0] - y) * 0.877
        strength, angle = rng.uniform(0.8, 1.2), 2 * np.pi * rng.uniform(-0.05, 0.05)
        u, v = strength * (u * np.cos(angle) - v * np.sin(angle)), strength * (u * np.sin(angle) + v * np.cos(angle))
        r, b = y + v / 0.877, y + u / 0.492
        x = np.stack([r, (y - 0.299 * r - 0.114 * b) / 0.587, b], axis=-1)
        image = np.clip(x * 255, 0, 255).astype(np.uint8)
    return np.ascontiguousarray(image), np.ascontiguousarray(mask)


def augment(df: DataFrame, key: str, image: str, mask: str, side: int, seed: int = SEED, epoch: int = 0, jitter: bool = False) -> DataFrame:
    """df with image (interleaved RGB bytes) and mask (a byte per pixel) of square tiles turned and flipped alike."""

    def run(batches):
        for pdf in batches:
            done = [augment_arrays(np.frombuffer(i, np.uint8).reshape(side, side, 3), np.frombuffer(m, np.uint8).reshape(side, side), generator(seed + epoch, k), jitter) for k, i, m in zip(pdf[key], pdf[image], pdf[mask], strict=True)]
            yield pdf.assign(**{image: [i.tobytes() for i, _ in done], mask: [m.tobytes() for _, m in done]})

    return df.mapInPandas(run, df.schema)
