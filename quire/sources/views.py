"""Tables, and views derived from them that stand for an application's own tables. No clock, no random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_ASOF, ORDERS_ASOF = "2024-01-31 00:00:00", "2001-08-01 00:00:00"
LINES_PER_PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".docx", ".DOC", ".txt", ".exe", "")]), (i % 6 + 1).cast("int"))
    return docs.select(i.alias("file_id"), (i % 20).alias("user_id"), F.concat(F.lit("doc_"), i.cast("string"), ext).alias("name"), F.coalesce("text", F.lit("")).alias("content"), i.alias("arrival"), F.when(i % 17 == 0, "failed").otherwise("ok").alias("status"))


def usage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("operation_type"), F.concat(F.lit("model-"), (F.col("event_id") % 5).cast("string")).alias("model"), F.floor(F.col("value") * 1000).cast("long").alias("input_tokens"), F.floor(F.col("value") * 100).cast("long").alias("output_tokens"), F.col("ts").cast("timestamp").alias("ts"))


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    limit = F.when(u % 50 == 0, F.lit("0.00")).otherwise("15.00").cast("decimal(10,4)")
    plan = F.when(u % 3 == 0, "free").when(u % 3 == 1, "pro").otherwise("premium")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", limit.alias("monthly_limit"), plan.alias("plan"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("operation"), (F.col("value") / 1000).alias("duration_s"), "ts")


STEPS = ("upload", "validation", "classification", "content_extraction", "l1_chunking", "l2_chunking", "vector_storage", "llm_processing", "pdf_generation")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, v = table(spark, sf_dir, "events"), F.col("event_id"), F.col("value")
    secs = dict(zip(STEPS, ((i % 40), v / 100, v / 150, v / 10, i % 7, i % 13, i % 3, v / 5, F.lit(0)), strict=True))
    return e.select(i.alias("session_id"), "user_id", F.col("ts").alias("ended_at"), ((F.col("event_type") != "error") & (i % 11 != 0)).alias("success"), *[x.cast("double").alias(k) for k, x in secs.items()], ((i % 100 + 1) * 100000).alias("size_bytes"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).unpivot(["session_id", "success", "ended_at"], list(STEPS), "step", "secs")


def email_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(k % 10 == 0, "discarded").when(s == "P", "pending").when(s == "O", "processing").otherwise("completed")
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), status.alias("status"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i, t = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("conv_id"), F.col("turn")
    forward = F.when(t % 4 == 2, F.concat(F.lit("\n---------- Forwarded message ---------\n"), "text")).when(t % 4 == 3, F.concat(F.lit("\nBEGIN forwarded message:\n"), "text")).otherwise("")
    mid = F.when(i % 9 == 0, F.concat(F.lit("m"), i)).otherwise(F.concat(F.lit("m"), i, F.lit("-"), t))
    at = F.timestamp_micros((F.lit(1704067200) + (i * 37 + t) * 60) * 1_000_000).cast("timestamp_ntz")
    to = F.array(F.lit("other@example.org"), F.concat(F.lit("U"), (i % 40).cast("string"), F.lit("@in.example.com")))
    return c.select((i * 100 + t).alias("email_id"), "conv_id", "turn", F.concat(F.lit(" User"), (i % 50).cast("string"), F.lit("@Example.COM ")).alias("sender"), to.alias("recipients"), mid.alias("message_id"), F.concat("text", forward).alias("body"), at.alias("received_at"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.concat(F.lit("u"), k, F.lit("@in.example.com")).alias("alias"), (k % 7 != 0).alias("is_active"), F.when(k % 11 != 0, F.concat(F.lit("agent-"), k % 5)).alias("default_agent"))


def senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    expires = F.when(k % 6 != 0, F.date_add(F.lit("2001-07-01").cast("date"), (k % 60).cast("int")).cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.concat(F.lit("user"), k % 50, F.lit("@example.com")).alias("email"), F.when(k % 3 == 0, "pending").otherwise("verified").alias("status"), F.concat(F.lit("tok"), k).alias("token"), expires.alias("expires_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.when(k % 19 == 0, "blocked").otherwise("active").alias("status"), F.col("c_name").alias("name"))


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 12 == 5, "blocked").otherwise("active").alias("status"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 4 != 0).select(F.col("c_nationkey").alias("org_id"), k.alias("user_id"), F.when(k % 10 == 0, "admin").otherwise("user").alias("role"), F.when(k % 23 == 0, "blocked").otherwise("active").alias("status"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("session_id"), k.alias("user_id"), F.when(k % 5 == 0, F.lit("2001-07-15").cast("date")).alias("revoked_at"), F.date_add(F.lit("2001-06-01").cast("date"), (k % 120).cast("int")).alias("expires_at"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("agent_id"), (k % 3 != 0).alias("is_custom"), (k % 1500).alias("owner_id"), F.when(k % 5 != 0, k % 25).alias("org_id"))
