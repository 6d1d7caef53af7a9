"""Image folders, packed digit files, .npy tiles and staging."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlight.functions.names import category_of


def unzip_if_missing(archive: str, folder: str) -> bool:
    """Extracts into the folder's parent unless the folder has something in it; says whether it did."""
    target = Path(folder)
    if target.is_dir() and any(target.iterdir()):
        return False
    with zipfile.ZipFile(archive) as z:
        z.extractall(target.parent)
    return True


def exists(path: str) -> bool:
    """Whether a file or folder is there, in whatever store its scheme names."""
    spark = SparkSession.getActiveSession()
    if "://" not in path or spark is None:
        return os.path.exists(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def require(path: str, hint: str) -> str:
    """The path, or an error that says how to get what is missing."""
    if not path or not exists(path):
        raise FileNotFoundError(f"{path} is missing: {hint}")
    return path


def config(name: str, default: str | None = None, env_file: str | None = None) -> str | None:
    """A setting from the environment, or from lines NAME=value of a file."""
    if name in os.environ:
        return os.environ[name]
    if env_file and os.path.exists(env_file):
        for line in Path(env_file).read_text().splitlines():
            key, eq, value = line.partition("=")
            if eq and key.strip() == name:
                return value.strip().strip("\"'")
    return default


def categories(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """label, category: folders with images, numbered by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    names = files.select(category_of(F.col("path")).alias("category")).distinct()
    return names.withColumn("label", F.dense_rank().over(Window.orderBy("category")) - 1)


def image_folder(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """image_id, path, category, label, h, w, c, pixels (interleaved RGB, 0..255) of folder/category/file; gray images get
    three equal channels. Ids count by category and path."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("dropInvalid", "true").load(folder).select("image.*")
    named = raw.withColumn("category", category_of(F.col("origin")))
    labels = categories(spark, folder, pattern)
    per = Window.partitionBy("category").orderBy("origin")
    sizes = named.groupBy("category").count().select(F.col("category").alias("_c"), (F.sum("count").over(Window.orderBy("category")) - F.col("count")).alias("_before"))
    rgb = _rgb(F.col("data"), F.col("nChannels"))
    return (
        named.withColumn("_n", F.row_number().over(per) - 1)
        .join(F.broadcast(sizes), F.col("category") == F.col("_c"))  # one row per category
        .join(F.broadcast(labels), "category")
        .select((F.col("_n") + F.col("_before")).cast("long").alias("image_id"), F.col("origin").alias("path"), "category", "label", F.col("height").alias("h"), F.col("width").alias("w"), F.lit(3).alias("c"), rgb.alias("pixels"))
    )


def _rgb(data, channels):
    @F.pandas_udf("binary")
    def run(d, n):
        import pandas as pd

        def one(b, k):
            a = np.frombuffer(b, np.uint8).reshape(-1, k)
            return (np.repeat(a, 3, axis=1) if k == 1 else a[:, 2::-1]).tobytes()

        return pd.Series([one(b, k) for b, k in zip(d, n, strict=True)], dtype=object)

    return run(data, channels)


def resize_nearest(df: DataFrame, side: int, pixels: str = "pixels") -> DataFrame:
    """df with square images of one side, by nearest pixel."""

    @F.pandas_udf("binary")
    def run(d, hs, ws):
        import pandas as pd

        def one(b, h, w):
            a = np.frombuffer(b, np.uint8).reshape(h, w, -1)
            return np.ascontiguousarray(a[np.arange(side) * h // side][:, np.arange(side) * w // side]).tobytes()

        return pd.Series([one(*x) for x in zip(d, hs, ws, strict=True)], dtype=object)

    return df.withColumn(pixels, run(pixels, "h", "w")).withColumn("h", F.lit(side)).withColumn("w", F.lit(side))


def cubic_weights(size: int, side: int) -> np.ndarray:
    """side x size: how much each of ``size`` pixels gives to each of ``side``, by cubic convolution (a = -0.5) whose width grows with
    the reduction; in units of 2 ** -22, as image libraries round them."""
    scale = size / side
    wide = max(scale, 1.0)
    centre = (np.arange(side) + 0.5) * scale
    low, high = np.maximum((centre - 2 * wide + 0.5).astype(int), 0), np.minimum((centre + 2 * wide + 0.5).astype(int), size)
    at = np.arange(size)
    x = np.abs((at + 0.5 - centre[:, None]) / wide)
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
    w = np.where((at >= low[:, None]) & (at < high[:, None]), w, 0)
    w /= w.sum(1, keepdims=True)
    return np.where(w < 0, np.ceil(w * (1 << 22) - 0.5), np.floor(w * (1 << 22) + 0.5)).astype(np.int64)


def shrink_cubic(image: np.ndarray, side: int) -> np.ndarray:
    """A square image of bytes: columns first, then rows, rounded to bytes after each."""
    for axis in (1, 0):
        if image.shape[axis] != side:
            summed = np.tensordot(cubic_weights(image.shape[axis], side), image.astype(np.int64), (1, axis))
            image = np.moveaxis(np.clip((summed + (1 << 21)) >> 22, 0, 255).astype(np.uint8), 0, axis)
    return np.ascontiguousarray(image)


def resize(df: DataFrame, side: int, pixels: str = "pixels") -> DataFrame:
    """df with square images of one side, by cubic interpolation as in common image libraries."""

    @F.pandas_udf("binary")
    def run(d, hs, ws):
        import pandas as pd

        return pd.Series([shrink_cubic(np.frombuffer(b, np.uint8).reshape(h, w, -1), side).tobytes() for b, h, w in zip(d, hs, ws, strict=True)], dtype=object)

    return df.withColumn(pixels, run(pixels, "h", "w")).withColumn("h", F.lit(side)).withColumn("w", F.lit(side))


def unpack(df: DataFrame, pixels: str = "pixels", out: str = "values") -> DataFrame:
    """df with bytes as numbers 0..1."""

    @F.pandas_udf("array<double>")
    def run(d):
        import pandas as pd

        return pd.Series([np.frombuffer(b, np.uint8) / 255.0 for b in d], dtype=object)

    return df.withColumn(out, run(pixels))


def digits(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """image_id, label, pixels of a pair of IDX files (one row per digit)."""
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            for a, b in zip(pdf.images, pdf.labels, strict=True):
                n, h, w = (int.from_bytes(a[k : k + 4], "big") for k in (4, 8, 12))
                grid = np.frombuffer(a, np.uint8, n * h * w, 16).reshape(n, h * w)
                marks = np.frombuffer(b, np.uint8, n, 8)
                import pandas as pd

                for at in range(0, n, 1000):
                    part = slice(at, at + 1000)
                    yield pd.DataFrame({"image_id": np.arange(n)[part], "label": marks[part].astype(np.int32), "pixels": [x.tobytes() for x in grid[part]]})

    files = spark.read.format("binaryFile").load([images, labels])
    mine = lambda path: F.max(F.when(F.col("path").endswith(path.rsplit("/", 1)[-1]), F.col("content")))
    both = files.agg(mine(images).alias("images"), mine(labels).alias("labels"))
    return both.mapInPandas(run, T.StructType([T.StructField("image_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("pixels", T.BinaryType())]))


class NpySource(DataSource):
    """spark.read.format("npy").load(folder): name, shape, dtype, data of every .npy file of a folder that all nodes see."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "name string, shape array<int>, dtype string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"])


class _NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.path).rglob("*.npy"))]

    def read(self, partition):
        a = np.load(partition.value)
        yield Path(partition.value).stem, list(a.shape), str(a.dtype), a.tobytes()


def npy(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(require(folder, "write tiles first"))
