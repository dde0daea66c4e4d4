"""Raw files of any kind in a folder, by Spark's binaryFile source."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 << 20


def _source(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name, size, modified of the files below path that have bytes and are there. Contents are not read."""
    rows = _source(spark, path, glob)
    return rows.select("path", F.col("_metadata.file_name").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """path, content of the files with max_bytes at most that can be read. The size is checked before a file is opened."""
    return _source(spark, path, glob).where(F.col("length") <= max_bytes).select("path", "content")


def _missed(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, size (null if the file isn't there) of files that the source passes over. They are asked for one by one: empty and lost files are few."""
    rows = []
    for r in paths.toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        rows.append((r["path"], fs.getFileStatus(p).getLen() if fs.exists(p) else None))
    return spark.createDataFrame(rows, "path string, missed_size bigint")


def scan_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """A row for each file below path: path, name, size, modified, content_hash (SHA-256, lowercase hex), status.

    Subfolders are included; names that start with `_` or `.` are not. status is `ok`, `empty` (no bytes), `too large` (over max_bytes: not opened) or
    `unreadable` (it went away or failed after Spark listed it); only files that are ok have a hash. One bad file doesn't end
    the scan. Files are hashed where they are read; contents don't shuffle. Names come from Spark's own
    listing, which the driver holds in any case. An empty folder gives no rows; a path that doesn't exist is an error.
    """
    names = [(unquote(p).replace("file:///", "file:/", 1),) for p in _source(spark, path, glob).inputFiles()]
    every = spark.createDataFrame(names, "path string").distinct()
    listed = list_files(spark, path, glob)
    hashed = read_files(spark, path, max_bytes, glob).select("path", F.sha2("content", 256).alias("content_hash"))
    missed = _missed(spark, every.join(listed.select("path").hint("merge"), "path", "left_anti"))
    out = every.join(listed.hint("merge"), "path", "left").join(hashed.hint("merge"), "path", "left").join(missed.hint("merge"), "path", "left")
    size = F.coalesce("size", "missed_size")
    status = F.when(size > max_bytes, "too large").when(F.col("content_hash").isNotNull(), "ok").when(size == 0, "empty").otherwise("unreadable")
    return out.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), size.alias("size"), "modified", "content_hash", status.alias("status"))
