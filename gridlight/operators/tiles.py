"""Masks, palettes and tiles. The long form of an image is a row per pixel: image id, y, x, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.functions.names import tile_name

#: Land cover classes in order, with their colours (fixed values).
PALETTE = (
    (0, "Urban", 0, 255, 255),
    (1, "Agriculture", 255, 255, 0),
    (2, "Rangeland", 255, 0, 255),
    (3, "Forest", 0, 255, 0),
    (4, "Water", 0, 0, 255),
    (5, "Barren", 255, 255, 255),
    (6, "Unknown", 0, 0, 0),
)


def palette(spark) -> DataFrame:
    return spark.createDataFrame(list(PALETTE), "class_id int, name string, r int, g int, b int")


def decode(pixels: DataFrame, default: int = 0) -> DataFrame:
    """pixels (r, g, b) with class_id; a colour that is not in the palette is class ``default``, and matched says so."""
    table = F.broadcast(palette(pixels.sparkSession).select("r", "g", "b", "class_id"))  # seven rows
    out = pixels.join(table, ["r", "g", "b"], "left")
    return out.withColumn("matched", F.col("class_id").isNotNull()).withColumn("class_id", F.coalesce("class_id", F.lit(default)))


def encode(pixels: DataFrame, column: str = "class_id") -> DataFrame:
    """pixels with the colour of their class."""
    table = F.broadcast(palette(pixels.sparkSession).select(F.col("class_id").alias("_c"), "r", "g", "b"))
    return pixels.join(table, F.col(column) == F.col("_c")).drop("_c")


def long_form(df: DataFrame, vector: str, width: int, keep: tuple[str, ...]) -> DataFrame:
    """A row per pixel: keep, y, x, value."""
    long = df.select(*keep, F.posexplode(vector).alias("i", "value"))
    return long.select(*keep, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "value")


def crop(v: Column, width: int, top: Column, left: Column, size: int) -> Column:
    """A square of a flat image."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(v, (top + r) * width + left + 1, size)))


def grid_tiles(df: DataFrame, vector: str, height: int, width: int, size: int, image: str, grid: int | None = None) -> DataFrame:
    """df's other columns, r, c, name and tile: a square per cell of the grid; pixels beyond the last whole cell are left out."""
    rows, cols = grid or height // size, grid or width // size
    out = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return out.withColumn("name", tile_name(F.col(image), F.col("r"), F.col("c"))).withColumn("tile", crop(F.col(vector), width, F.col("r") * size, F.col("c") * size, size)).drop(vector)


def corner_tiles(df: DataFrame, vector: str, height: int, width: int, size: int, image: str) -> DataFrame:
    """As grid_tiles, with the four squares in the corners, which may overlap or leave a cross out."""
    spots = lambda n: F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(o).alias("o")) for i, o in enumerate((0, n - size))]))
    out = df.withColumn("_y", spots(height)).withColumn("_x", spots(width)).withColumn("r", F.col("_y.k")).withColumn("c", F.col("_x.k"))
    tile = crop(F.col(vector), width, F.col("_y.o"), F.col("_x.o"), size)
    return out.withColumn("name", tile_name(F.col(image), F.col("r"), F.col("c"))).withColumn("tile", tile).drop(vector, "_y", "_x")


def box_downsample(pixels: DataFrame, factor: int, height: int, width: int, image: str, digits: int = 0) -> DataFrame:
    """Mean of every factor x factor block, rounded; pixels beyond the last whole block are left out."""
    used = pixels.where((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(f"b{c}")
    return used.groupBy(image, block("y"), block("x")).agg(F.round(F.avg("value"), digits).alias("value"))


def majority_vote(pixels: DataFrame, factor: int, image: str, label: str = "class_id") -> DataFrame:
    """The most frequent label of every block, of equally frequent ones the smallest."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(f"b{c}")
    counts = pixels.groupBy(image, block("y"), block("x"), label).count()
    return counts.groupBy(image, "by", "bx").agg(F.max_by(label, F.struct(F.col("count"), -F.col(label))).alias(label))


def pair(sat: DataFrame, mask: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Images with their masks: inner drops those without, left keeps them, left_semi and left_anti only tell."""
    return sat.join(mask, on, how)


def qubit_pairs(spark, n: int) -> DataFrame:
    """i < j of range(n)."""
    a = spark.range(n).select(F.col("id").cast("int").alias("i"))
    return a.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n - 1)))).where("i < j")
