"""Principal components: fitted by distributed sums of products, applied by expressions or vectorised maps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlight.functions.pixels import as_doubles


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def map_vectors(df: DataFrame, vector: str, out: str, kernel) -> DataFrame:
    """df with ``out``: kernel applied to batches of a vector column as a matrix."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*[f for f in df.schema if f.name != out], StructField(out, ArrayType(DoubleType()))])
    arrow, names = to_arrow_schema(schema), [f.name for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(b.schema.get_field_index(vector)))
                made = lists(kernel(x))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)).cast(arrow.field(n).type) for n in names], made.cast(arrow.field(out).type)], schema=arrow)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class PCAModel:
    components: np.ndarray  # k x d
    mean: np.ndarray
    ratio: np.ndarray

    def transform(self, df: DataFrame, vector: str, out: str = "scores", k: int | None = None) -> DataFrame:
        """(x - mean) on the first k components; asking for fewer computes fewer."""
        basis, mean = self.components[:k], self.mean
        return map_vectors(df, vector, out, lambda x: (x - mean) @ basis.T)

    def inverse(self, df: DataFrame, scores: str, out: str = "rebuilt") -> DataFrame:
        """Scores back to vectors; fewer scores than components count as followed by zeros."""
        basis, mean = self.components, self.mean
        return map_vectors(df, scores, out, lambda z: z @ basis[: z.shape[1]] + mean)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (of the sample), from one row of sums per task; rows of the covariance are summed up
    by Spark, so the driver gets d * d numbers, whatever the number of rows."""
    shift = np.array(df.select(as_doubles(F.col(vector)).alias("v")).first().v)
    d = len(shift)

    def run(batches):
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)) - shift
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            at = pa.array(np.arange(d + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([n] * (d + 1), pa.int64()), lists(np.vstack([s, ss]))], names=["at", "n", "v"])

    part = df.select(as_doubles(F.col(vector)).alias("v")).mapInArrow(run, "at int, n long, v array<double>")
    added = part.select("at", "n", F.posexplode("v").alias("i", "x")).groupBy("at", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    table = np.zeros((d + 1, d))
    for r in added:
        table[r["at"], r.i] = r.x
    n, s = added[0].n, table[0]
    return n, shift + s / n, (table[1:] - np.outer(s, s) / n) / max(1, n - 1)


def fit(df: DataFrame, vector: str, k: int) -> PCAModel:
    """The k leading components; of each the loading of the largest magnitude is positive."""
    _, mean, cov = moments(df, vector)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    basis = vectors[:, order].T
    basis *= np.sign(basis[np.arange(len(basis)), np.abs(basis).argmax(1)])[:, None]
    return PCAModel(basis, mean, values[order] / values.sum())


def explained(spark, model: PCAModel) -> DataFrame:
    """component, ratio, cumulative."""
    df = spark.createDataFrame([(i, float(r)) for i, r in enumerate(model.ratio)], "component int, ratio double")
    return df.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))


def covariance(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """i, j, cov of the first components, as a plain aggregation of products."""
    v = as_doubles(F.slice(F.col(vector), 1, dims))
    pairs = F.explode(F.flatten(F.transform(v, lambda x, i: F.transform(v, lambda y, j: F.struct(i.alias("i"), j.alias("j"), x.alias("x"), y.alias("y"))))))
    return df.select(pairs.alias("p")).select("p.*").where("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))
