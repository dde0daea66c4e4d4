"""Streams over the events table. Each query runs to the end of its input with an availableNow trigger and gives what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quire.operators.intake import normalize_email
from quire.operators.usage import DEFAULT_PRICE, HOURLY_BUCKET, PRICES
from quire.plans.registry import query
from quire.session import new_folder
from quire.sources.views import endpoints, table
from quire.streaming.state import HourlyCredits, LastSeen, MonthlyUse, TrailingCalls


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream. Its time has no zone, which watermarks refuse, so it becomes a timestamp.

    The path is a pattern since a plain one must be a folder.
    """
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def keyed(rows: DataFrame, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """processor over the rows of each user. Its state is kept in RocksDB, whatever the session's default."""
    return rows.groupBy("user_id").transformWithStateInPandas(processor, schema, "append", time)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    where, provider = new_folder(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)  # a query takes it when it starts
    try:
        q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/out")
        q.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def cost():
    model = F.concat(F.lit("model-"), (F.col("event_id") % 5).cast("string"))
    price = lambda i: F.coalesce(*[F.when(model == p[0], float(p[i])) for p in PRICES], F.lit(float(DEFAULT_PRICE[i - 1])))
    return (F.floor(F.col("value") * 1000) * price(1) + F.floor(F.col("value") * 100) * price(2)) / 1_000_000


_COST = "(floor(value * 1000) * p1 + floor(value * 100) * p2) / 1000000"
_PRICED = f"(SELECT *, {_COST} AS cost FROM (SELECT *, " + ", ".join(f"CASE 'model-' || event_id % 5 {' '.join(f'WHEN {chr(39)}{p[0]}{chr(39)} THEN CAST({p[i]} AS DOUBLE)' for p in PRICES)} ELSE CAST({DEFAULT_PRICE[i - 1]} AS DOUBLE) END AS p{i}" for i in (1, 2)) + " FROM events))"


@query("stream_usage", f"""SELECT CAST(ts AS DATE) AS day, user_id, round(sum(cost), 9) AS cost, count(*) AS calls FROM {_PRICED}
    GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_usage(spark, d):
    """Cost per user and day; days close a day behind the latest event."""
    rows = events(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "user_id").agg(F.round(F.sum(cost()), 9).alias("cost"), F.count(F.lit(1)).alias("calls"))
    return drained(rows.select(F.col("window.start").cast("date").alias("day"), "user_id", "cost", "calls"), "stream-usage")


@query("stream_rate_limit")
def stream_rate_limit(spark, d):
    """Calls of the trailing 24 hours, hour by hour."""
    rows = events(spark, d).where("ts is not null").withColumn("last", F.col("ts") + F.expr("INTERVAL 24 HOURS"))
    rows = rows.withWatermark("last", "25 hours")  # an hour behind the latest event; a row is late when its last window has ended
    rows = rows.select("user_id", "last", F.unix_micros("ts").alias("us"), F.coalesce(F.col("event_type") != "error", F.lit(False)).alias("counts"))
    out = keyed(rows, TrailingCalls(24), "user_id long, until long, n long", "EventTime")
    return drained(out.select(F.timestamp_micros("until").alias("until"), "user_id", "n", (F.col("n") < 20).alias("allowed")), "stream-rate")


@query("stream_dedup")
def stream_dedup(spark, d):
    """Repeated message ids drop out while the watermark holds their state."""
    rows = events(spark, d).withColumn("message_id", F.col("event_id") % 9000).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["message_id"])
    return drained(rows.select("message_id", "event_id", "ts"), "stream-dedup")


@query("stream_intake", "SELECT e.event_id, p.user_id, CASE WHEN p.user_id IS NULL THEN 'unknown_alias' WHEN NOT p.is_active THEN 'inactive_alias' ELSE 'accepted' END AS decision FROM events e LEFT JOIN endpoints p ON p.alias = 'u' || e.user_id || '@in.example.com'")
def stream_intake(spark, d):
    """New messages meet the known aliases, and accepted ones are appended as jobs, batch by batch."""
    known = endpoints(spark, d).select("alias", "user_id", "is_active")
    where = new_folder(spark, "stream-intake")

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("alias", normalize_email(F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit("@in.example.com "))))
        rows = rows.drop("user_id").join(known, "alias", "left")
        decision = F.when(F.col("user_id").isNull(), "unknown_alias").when(~F.col("is_active"), "inactive_alias").otherwise("accepted")
        out = rows.select("event_id", "user_id", decision.alias("decision"))
        out.write.mode("overwrite").parquet(f"{where}/jobs/batch={number}")  # a batch that runs again replaces its own rows

    q = events(spark, d).writeStream.foreachBatch(put).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/jobs").drop("batch")


@query("stream_quota_state", f"""SELECT user_id, event_id, month, round(used, 9) AS used, (CASE WHEN used / 15 * 100 >= 100 THEN 3 WHEN used / 15 * 100 >= 90 THEN 2 WHEN used / 15 * 100 >= 70 THEN 1 ELSE 0 END)::INTEGER AS level
    FROM (SELECT user_id, event_id, strftime(ts, '%Y-%m') AS month, sum(cost) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM {_PRICED})""")
def stream_quota_state(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "ts", cost().alias("cost"))
    return drained(keyed(rows, MonthlyUse(15.0), "user_id long, event_id long, month string, used double, level int"), "stream-quota")


@query("stream_credit_bucket", HOURLY_BUCKET)
def stream_credit_bucket(spark, d):
    rows = events(spark, d).select("user_id", "event_id", F.unix_micros("ts").alias("us"), (F.col("event_id") % 60).alias("cost"))
    return drained(keyed(rows, HourlyCredits(), "user_id long, event_id long, granted boolean"), "stream-bucket")


@query("stream_ttl")
def stream_ttl(spark, d):
    """Users without an event for two hours of event time, with their last one and the number of their events."""
    rows = events(spark, d).withWatermark("ts", "10 minutes").select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return drained(keyed(rows, LastSeen(), "user_id long, last_seen timestamp, n long", "EventTime"), "stream-ttl")
