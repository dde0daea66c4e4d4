"""What the operators share: the shared folder, written tables, reading, global ranks."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20  # of an Arrow batch that goes to Python, whichever comes first
BROADCAST_ROWS = 200_000  # narrow rows (two numbers or so) that are sent to all tasks
WORD = r"[^\x20\x09-\x0D]+"
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quire-checkpoint-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application in the shared one; what is still there goes when the driver ends."""
    top = f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}"
    fs, p = _path(spark, top)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _path(spark, path)
        fs.delete(p, True)
        if path in (_made.get() or []):
            _made.get().remove(path)


class Scratch(list):
    """Folders to remove."""

    def keep(self, *frames: DataFrame) -> None:
        """Those of staged frames stay; they are the surrounding scratch's, if there is one."""
        for df in frames:
            self.remove(df.folder)
            self.kept.append(df.folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Folders made inside go at the end, but for those kept. All that reads them must have been written by then."""
    made, outer = Scratch(), _made.get()
    made.kept = []
    token = _made.set(made)
    try:
        yield made
    finally:
        removed(spark, *made[:])
        _made.reset(token)
        if outer is not None:
            outer += made.kept


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows or BATCH_BYTES bytes at most, since texts can be long; the session's own setting comes back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and Spark knows the size. Python in it gets small batches."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at its end the worker gives the memory that it holds free back, since workers outlive their tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries give back by themselves
            if trim:
                trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def sent(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """side, hinted for its join: broadcast up to `most` rows, which are counted, else merged."""
    return F.broadcast(side) if side.count() <= most else side.hint("merge")


def global_row_number(df: DataFrame, key: str, out: str, name: str) -> DataFrame:
    """Number rows from 0 in ascending key order (null last) by range partitions; no task sees all rows.

    The prefix sum runs over one row per range partition.
    """
    spark = df.sparkSession
    null_key, where, place = "__null", "__part", "__place"
    parts = df.withColumn(null_key, F.col(key).isNull()).repartitionByRange(n_parts(spark), null_key, key)
    parts = parts.withColumn(where, F.spark_partition_id())
    parts = parts.withColumn(place, F.row_number().over(W.partitionBy(where).orderBy(null_key, key)) - 1)
    parts = staged(parts, name)
    bases = parts.groupBy(where).agg(F.count(F.lit(1)).alias("__n"))
    bases = bases.withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy(where).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    both = parts.join(bases.drop("__n"), where)
    return both.withColumn(out, F.col("__base") + F.col(place)).drop(where, place, null_key, "__base")
