"""What the corpus operators share: durable tables, Arrow maps and word splitting."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but these six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text that one step of a Python map holds at once, and rows of an Arrow batch, instead of Spark's 10000.
SLICE, BATCH = 512, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session, whose executors
    are in the driver's process, uses the driver's temporary folder; any other master is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/checkpoints"


#: What each open scratch() has to delete, the innermost last.
_made: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("made", default=())
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that durable() writes inside are deleted at the end; those with keep=True at the end of the scratch around it."""
    mine: list[str] = []
    token = _made.set((*_made.get(), mine))
    try:
        yield
    finally:
        _made.reset(token)
        for path in mine:
            _delete(spark, path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that durable() wrote, once nothing lazy reads them any more."""
    for t in tables:
        if path := _places.pop(t, None):
            _delete(t.sparkSession, path)


def durable(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/gridlight-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _made.get()[: -1 if keep else None]
    if made:
        made[-1].append(path)
    # what nobody releases goes when the session's JVM ends
    at, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsparkSession.sessionState().newHadoopConf()
    at.getFileSystem(conf).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def stored(spark: SparkSession, name: str, make: Callable[[], bytes]) -> bytes:
    """What make() gives, kept in the shared folder under a name that says all that it depends on; made once for all sessions."""
    path = f"{shared_dir(spark)}/gridlight-{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(hadoop(f"{path}/_SUCCESS")):
        return bytes(spark.read.parquet(path).first()[0])
    value = make()
    part = f"{path}-{uuid.uuid4().hex}"
    spark.createDataFrame([(value,)], "value binary").coalesce(1).write.parquet(part)
    if fs.exists(hadoop(path)) or not fs.rename(hadoop(part), hadoop(path)):  # another session was first
        fs.delete(hadoop(part), True)
    return value


def bounded(spark: SparkSession) -> None:
    """Arrow batches of documents that both sides of a Python worker can hold several of; a setting of one's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[list[list]], list[list]], schema: str, rows: int = SLICE) -> DataFrame:
    """mapInArrow over slices of ``rows`` rows: make takes the input columns as Python lists, returns output columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = make([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


class Maybe:
    """Whether a hash may be among those of a table: no false negatives, and 8 MB whatever the number of hashes. Three bits
    stand for a hash; with a million hashes one foreign hash in 10,000 passes."""

    BITS, SHIFTS = 1 << 26, (0, 19, 38)

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: int) -> bool:
        return bool(self.many(np.array([h]).astype(np.uint64).view(np.int64))[0])

    def many(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in self.SHIFTS:
            at = (h.astype(np.int64).view(np.uint64) >> np.uint64(s)) & np.uint64(self.BITS - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def maybe(keys: DataFrame, column: str) -> Maybe:
    places = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(Maybe.BITS - 1)) for s in Maybe.SHIFTS])
    at = keys.select(F.explode(places).alias("at")).distinct()
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
    words = np.zeros(Maybe.BITS // 64, np.uint64)
    got = rows.toArrow()  # at most BITS / 64 rows
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Maybe(words)


def n_words(text: Column) -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")
