"""stream_rate_limit: what it shuffles, and its rows over several triggers, with users and times that are missing."""

import datetime as dt
import os

from pyspark.sql import functions as F

from quire.plans.registry import queries
from quire.sources.views import table
from quire.streaming import queries as streams
from tests.test_sizes import shuffled

DATA = "/root/testdata/sf0.001"


def test_calls_are_not_multiplied_by_windows(spark):
    rows, _ = shuffled(spark, lambda: queries()["stream_rate_limit"](spark, DATA))
    assert rows <= table(spark, DATA, "events").count()


def test_windows_over_several_triggers(spark, tmp_path, monkeypatch):
    """Each window comes once, with all its calls, whether they came in one trigger or several."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    at = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute)
    rows = [(1, at(1, 0, 5), 1), (2, at(1, 0, 7), 1), (3, at(1, 9), 2), (4, at(2, 5, 30), 1), (5, at(2, 4, 50), 2), (6, at(4, 3, 20), 1), (7, at(4, 3), None), (8, None, 1), (9, at(5, 2, 30), 3)]
    rows = [(i, ts, user, "error" if i == 2 else "view", 1.0, "") for i, ts, user in rows]
    folder = tmp_path / "events.parquet"
    os.makedirs(folder)
    for k, own in enumerate((rows[:3], rows[3:5], rows[5:])):
        path = tmp_path / f"part{k}"
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(path))
        os.rename(next(p for p in path.iterdir() if p.suffix == ".parquet"), folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k * 100,) * 2)
    want = spark.createDataFrame(rows, schema).where("ts is not null").groupBy(F.window(F.col("ts").cast("timestamp"), "24 hours", "1 hour"), "user_id").agg(F.count_if(F.col("event_type") != "error").alias("n"))
    want = {(r.until, r.user_id, r.n) for r in want.select(F.col("window.end").alias("until"), "user_id", "n").where(F.col("until") <= F.lit(at(5, 1, 30)).cast("timestamp")).collect()}
    for files in (1, 10):
        source = lambda spark, d, files=files: spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", files).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
        monkeypatch.setattr(streams, "events", source)
        got = queries()["stream_rate_limit"](spark, DATA).collect()
        assert len(got) == len(want) and {(r.until, r.user_id, r.n) for r in got} == want and all(r.allowed == (r.n < 20) for r in got)
