"""The test tables in the shapes that the operators work on, and small made-up tables by integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.functions.pixels import as_doubles
from gridlight.operators.scaling import element_range

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, v: embeddings as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", as_doubles(F.col("embedding")).alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, pixels: embeddings as 8 x 8 images, scaled to 0..1 by the range of all elements."""
    raw = vectors(spark, sf_dir)
    low, high, _, _ = element_range(raw, "v")
    return raw.select("image_id", "label", F.transform("v", lambda x: (x - F.lit(low)) / (F.lit(high) - F.lit(low))).alias("pixels"))


def class_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, pixels of 0..6: every pixel of images() as one of seven classes."""
    return images(spark, sf_dir).select("image_id", F.transform("pixels", lambda x: F.least(F.floor(x * 7), F.lit(6)).cast("int")).alias("classes"))


def images16(spark: SparkSession) -> DataFrame:
    """100 made-up images of 16 x 16."""
    pixel = lambda i: (F.col("id") * 31 + F.floor(i / 16) * 7 + (i % 16) * 13) % 256
    return spark.range(100).select(F.col("id").alias("image_id"), (F.col("id") % 10).cast("int").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: pixel(i) / F.lit(255.0)).alias("pixels"))


def probs(spark: SparkSession) -> DataFrame:
    """12 samples of 3 classes in 3 images: sample, image, label, p; sample 4 has equal maxima."""
    w = lambda c: (F.col("id") * 3 + c * 5) % 7 + 1
    total = w(0) + w(1) + w(2)
    return spark.range(12).select(F.col("id").alias("sample"), F.floor(F.col("id") / 4).alias("image"), ((F.col("id") * 2) % 3).cast("int").alias("label"), F.array(*[w(c) / total for c in range(3)]).alias("p"))


def history(spark: SparkSession) -> DataFrame:
    """60 epochs of a run whose loss is best at 25."""
    return spark.range(60).select(F.lit("run").alias("run_id"), F.col("id").cast("int").alias("epoch"), (F.abs(F.col("id") - 25) / F.lit(100.0) + F.lit(0.1)).alias("val_loss"))


def rgb_pixels(spark: SparkSession) -> DataFrame:
    """y, x, r, g, b of an 8 x 8 image that goes through the palette and one colour that is not in it."""
    from gridlight.operators.tiles import palette

    colours = palette(spark).select("class_id", "r", "g", "b").union(spark.createDataFrame([(7, 1, 2, 3)], "class_id int, r int, g int, b int"))
    at = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") % 8).cast("int").alias("class_id"))
    return at.join(F.broadcast(colours), "class_id").select("y", "x", "r", "g", "b")
