"""Writers: tiles, caches by configuration, histories, tracking tables, model registry, reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet, a folder per split."""
    tiles.write.mode("overwrite").partitionBy("split").parquet(path)


def write_npy(tiles: DataFrame, folder: str, name: str, vector: str, side: int, suffix: str = "sat", channels: int = 1) -> int:
    """Tiles as {name}_{suffix}.npy files in a folder that all nodes see, for tools that read those; returns how many."""
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        for pdf in batches:
            for n, v in zip(pdf[name], pdf[vector], strict=True):
                np.save(f"{folder}/{n}_{suffix}.npy", np.asarray(v).astype(np.uint8).reshape((side, side, channels) if channels > 1 else (side, side)))
            yield pdf[[name]]

    return tiles.select(name, vector).mapInPandas(run, f"{name} string").count()


def cached(spark: SparkSession, path: str, key: str, make) -> DataFrame:
    """The table under path/key if it is there whole, else make()'s rows, written there first."""
    full = f"{path}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{full}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def save_arrays(folder: str, **arrays: np.ndarray) -> None:
    """Weights, scalers and other small models."""
    os.makedirs(folder, exist_ok=True)
    np.savez(f"{folder}/arrays.npz", **arrays)


def load_arrays(folder: str) -> dict[str, np.ndarray]:
    with np.load(f"{folder}/arrays.npz") as z:
        return {k: z[k] for k in z.files}


def train_or_load(folder: str, train, overwrite: bool = False) -> dict[str, np.ndarray]:
    """Arrays from the folder, or those that train() returns, saved there."""
    if overwrite or not os.path.exists(f"{folder}/arrays.npz"):
        save_arrays(folder, **train())
    return load_arrays(folder)


def latest(registry: str, prefix: str) -> str:
    """The newest of the models saved as registry/prefix-stamp."""
    found = sorted(Path(registry).glob(f"{prefix}-*"))
    if not found:
        raise FileNotFoundError(f"no model {prefix} in {registry}: train one first")
    return str(found[-1])


def write_history(history: list[dict], path: str) -> None:
    """Metric to list of a value per epoch, as JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({k: [h[k] for h in history] for k in history[0] if k != "epoch"} if history else {}))


def read_history(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """run_id, epoch, metric, value of such a file."""
    raw = spark.read.option("wholetext", "true").text(path)
    maps = raw.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("metric", "values"))
    return maps.select(F.lit(run_id).alias("run_id"), F.posexplode("values").alias("epoch", "value"), "metric").select("run_id", "epoch", "metric", "value")


def track(spark: SparkSession, path: str, run_id: str, config: dict, metrics: list[tuple[str, int, float]]) -> None:
    """Appends a run and its metrics (name, step, value) to the tables path/runs and path/metrics."""
    spark.createDataFrame([(run_id, json.dumps(config, sort_keys=True))], "run_id string, config string").write.mode("append").parquet(f"{path}/runs")
    spark.createDataFrame([(run_id, *m) for m in metrics], "run_id string, metric string, step int, value double").write.mode("append").parquet(f"{path}/metrics")


def report(scores: DataFrame, name: str, *metrics: str) -> DataFrame:
    """Lines of a fixed-width table."""
    return scores.select(F.format_string("%-28s" + " %10.5f" * len(metrics), F.col(name), *[F.col(m).cast("double") for m in metrics]).alias("line"))
