"""Operational metrics: sessions, steps and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.session import staged
from quire.sources.views import STEPS, sessions, steps, timings

#: Seconds above which a step counts as slow; chunking is the slower of its two levels.
LIMITS = {"upload": 5.0, "validation": 2.0, "classification": 1.0, "content_extraction": 10.0, "chunking": 15.0, "vector_storage": 5.0, "llm_processing": 30.0, "pdf_generation": 10.0}
MB = 1024 * 1024


def _total():
    out = F.lit(0.0)
    for s in STEPS:
        out = out + F.col(s)
    return out


def last_sessions(rows: DataFrame, n: int) -> DataFrame:
    """The last n sessions by end time: a top-n, not a sort of all."""
    return rows.orderBy(F.col("ended_at").desc(), F.col("session_id").desc()).limit(n)


def bottleneck(rows: DataFrame) -> DataFrame:
    """session_id, step, secs, share of the slowest positive step; ties go to the first name."""
    out = rows.where("secs > 0").groupBy("session_id").agg(F.sum("secs").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("secs")).alias("k"), "step"))).alias("all"))
    first = F.col("all")[0]
    return out.select("session_id", first["step"].alias("step"), (-first["k"]).alias("secs"), (-first["k"] / F.col("total") * 100).alias("share"))


_TOTAL = " + ".join(STEPS)
_LAST = "(SELECT *, {t} AS total FROM sessions ORDER BY ended_at DESC, session_id DESC LIMIT 1000)".format(t=_TOTAL)
_TOP = "(SELECT session_id, success, step, secs, secs / sum(secs) OVER (PARTITION BY session_id) * 100 AS share, row_number() OVER (PARTITION BY session_id ORDER BY secs DESC, step) AS r FROM steps WHERE secs > 0)"


@query("session_summary", f"""SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate,
    round(avg(total) FILTER (success), 6) AS avg_seconds, round(avg(size_bytes / 1048576.0), 6) AS avg_mb, round(avg(CASE WHEN total > 0 THEN size_bytes / 1048576.0 / total ELSE 0 END) FILTER (success), 6) AS avg_rate FROM {_LAST}""")
def session_summary(spark, d, n: int = 1000):
    rows = last_sessions(sessions(spark, d), n).withColumn("total", _total()).withColumn("mb", F.col("size_bytes") / MB)
    ok = lambda x: F.when(F.col("success"), x)
    rate = F.coalesce(F.try_divide("mb", "total"), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.round(F.count_if("success") / F.count(F.lit(1)) * 100, 6).alias("success_rate"), F.round(F.avg(ok(F.col("total"))), 6).alias("avg_seconds"), F.round(F.avg("mb"), 6).alias("avg_mb"), F.round(F.avg(ok(rate)), 6).alias("avg_rate"))


def quantile(rows: DataFrame, key: str, value: str, q: float, bins: int = 4096, most: int = 100_000) -> DataFrame:
    """key, quantile: exact, between two values in proportion, as percentile gives it. No task holds all values of a key.

    A value's place is narrowed by histograms: each pass counts the rows in `bins` equal parts of the range that is left, and keeps the part with the
    wanted place, until at most `most` rows are in it or they are all equal. Nulls (and NaN) don't count; keys without values have no row.
    """
    v = F.col("__v")
    rows = rows.select(F.col(key).alias("__k"), F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    all_ = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    at = F.lit(q) * (F.col("n") - 1)
    places = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    left = staged(all_.select("__k", at.alias("at"), F.explode(places).alias("place"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), "n"), "places")
    while not left.where((F.col("n") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        own = left.withColumnRenamed("__k", "__own").withColumnRenamed("n", "__n")
        met = rows.join(own.hint("merge"), F.col("__k").eqNullSafe(F.col("__own")) & v.between(F.col("lo"), F.col("hi")))
        part = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)))
        counts = met.groupBy("__k", "at", "place", "below", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        upto = F.sum("n").over(W.partitionBy("__k", "place").orderBy("part"))  # `bins` rows at most
        counts = counts.withColumn("upto", F.col("below") + upto).where((F.col("upto") - F.col("n") <= F.col("place")) & (F.col("place") < F.col("upto")))
        left = staged(counts.select("__k", "at", "place", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"), "n"), "places")
    own = left.withColumnRenamed("__k", "__own")
    met = rows.join(own.hint("merge"), F.col("__k").eqNullSafe(F.col("__own")) & (F.col("lo") < F.col("hi")) & v.between(F.col("lo"), F.col("hi")))
    few = met.groupBy("__k", "at", "place", "below").agg(F.sort_array(F.collect_list(v)).alias("all"))  # `most` values at most
    exact = few.select("__k", "at", "place", F.get("all", (F.col("place") - F.col("below")).cast("int")).alias("x"))
    exact = exact.unionByName(left.where("lo = hi").select("__k", "at", "place", F.col("lo").alias("x")))
    ends = exact.groupBy("__k", "at").agg(F.min_by("x", "place").alias("a"), F.max_by("x", "place").alias("b"))
    return ends.select(F.col("__k").alias(key), (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"))


@query("operation_stats", """SELECT operation, count(*) AS n, round(avg(duration_s) * 1000, 6) AS mean_ms, round(median(duration_s) * 1000, 6) AS median_ms, round(min(duration_s) * 1000, 6) AS min_ms, round(max(duration_s) * 1000, 6) AS max_ms, round(coalesce(stddev_samp(duration_s), 0) * 1000, 6) AS std_ms FROM timings GROUP BY 1""")
def operation_stats(spark, d):
    rows = staged(timings(spark, d).select("operation", "duration_s"), "timings")
    x = F.col("duration_s")
    ms = lambda c, name: F.round(c * 1000, 6).alias(name)
    one = rows.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), ms(F.avg(x), "mean_ms"), ms(F.min(x), "min_ms"), ms(F.max(x), "max_ms"), ms(F.coalesce(F.stddev_samp(x), F.lit(0.0)), "std_ms"))
    median = quantile(rows, "operation", "duration_s", 0.5)
    return one.join(median.hint("merge"), "operation").select("operation", "n", "mean_ms", ms(F.col("quantile"), "median_ms"), "min_ms", "max_ms", "std_ms")


@query("bottleneck", f"SELECT session_id, step, round(secs, 6) AS secs, round(share, 6) AS share FROM {_TOP} WHERE r = 1")
def q_bottleneck(spark, d):
    return bottleneck(steps(spark, d)).select("session_id", "step", F.round("secs", 6).alias("secs"), F.round("share", 6).alias("share"))


@query("bottleneck_counts", f"SELECT step, count(*) AS n FROM {_TOP} WHERE r = 1 AND success GROUP BY 1")
def bottleneck_counts(spark, d):
    return bottleneck(steps(spark, d).where("success")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


_LIMITS = ", ".join(f"('{k}', {v})" for k, v in LIMITS.items())


@query("threshold_breaches", f"""SELECT session_id, step, round(secs, 6) AS secs, limit_s FROM (SELECT session_id, CASE WHEN step IN ('l1_chunking', 'l2_chunking') THEN 'chunking' ELSE step END AS step, max(secs) AS secs FROM steps GROUP BY 1, 2)
    JOIN (VALUES {_LIMITS}) l(step, limit_s) USING (step) WHERE secs > limit_s""".replace("limit_s FROM (", "CAST(limit_s AS DOUBLE) AS limit_s FROM ("))
def threshold_breaches(spark, d):
    step = F.when(F.col("step").isin("l1_chunking", "l2_chunking"), "chunking").otherwise(F.col("step"))
    rows = steps(spark, d).groupBy("session_id", step.alias("step")).agg(F.max("secs").alias("secs"))
    limit = F.coalesce(*[F.when(F.col("step") == k, v) for k, v in LIMITS.items()])
    return rows.withColumn("limit_s", limit).where("secs > limit_s").withColumn("secs", F.round("secs", 6))


@query("recent_errors", "SELECT session_id, 'failed after ' || CAST(upload AS BIGINT) || ' s' AS message FROM sessions WHERE NOT success ORDER BY ended_at DESC, session_id DESC LIMIT 5")
def recent_errors(spark, d, n: int = 5):
    return last_sessions(sessions(spark, d).where(~F.col("success")), n).select("session_id", F.concat(F.lit("failed after "), F.col("upload").cast("long").cast("string"), F.lit(" s")).alias("message"))


@query("session_details", f"SELECT session_id, round(({_TOTAL}) * 1000, 4) AS total_ms, round(size_bytes / 1048576.0, 6) AS mb, round(CASE WHEN ({_TOTAL}) > 0 THEN size_bytes / 1048576.0 / ({_TOTAL}) ELSE 0 END, 6) AS mb_per_s, round(l1_chunking - l2_chunking, 6) AS delta FROM sessions")
def session_details(spark, d):
    mb = F.col("size_bytes") / MB
    return sessions(spark, d).select("session_id", F.round(_total() * 1000, 4).alias("total_ms"), F.round(mb, 6).alias("mb"), F.round(F.coalesce(F.try_divide(mb, _total()), F.lit(0.0)), 6).alias("mb_per_s"), F.round(F.col("l1_chunking") - F.col("l2_chunking"), 6).alias("delta"))


@query("embed_stats", "SELECT operation, count(*) AS calls, (count(*) * 100)::BIGINT AS embeddings, round(avg(duration_s), 6) AS avg_time, round(count(*) FILTER (event_id % 9 = 0) / count(*) * 100, 6) AS error_rate FROM timings GROUP BY 1")
def embed_stats(spark, d, batch: int = 100):
    n = F.count(F.lit(1))
    return timings(spark, d).groupBy("operation").agg(n.alias("calls"), (n * batch).alias("embeddings"), F.round(F.avg("duration_s"), 6).alias("avg_time"), F.round(F.count_if(F.col("event_id") % 9 == 0) / n * 100, 6).alias("error_rate"))


@query("embed_retry_policy", """SELECT event_id, status, attempt, status IN (408, 429) OR status >= 500 AS transient, (status IN (408, 429) OR status >= 500) AND attempt < 2 AS retry, CASE WHEN attempt < 2 THEN 0.5 * power(2, attempt) ELSE 0 END AS backoff
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 503 END AS status, event_id % 3 AS attempt FROM events)""")
def embed_retry_policy(spark, d, most: int = 2):
    i = F.col("event_id")
    rows = timings(spark, d).select("event_id", F.element_at(F.array(*[F.lit(x) for x in (200, 429, 500, 404, 503)]), (i % 5 + 1).cast("int")).alias("status"), (i % 3).alias("attempt"))
    transient = F.col("status").isin(408, 429) | (F.col("status") >= 500)
    return rows.select("event_id", "status", "attempt", transient.alias("transient"), (transient & (F.col("attempt") < most)).alias("retry"), F.when(F.col("attempt") < most, 0.5 * F.pow(F.lit(2.0), F.col("attempt"))).otherwise(0.0).alias("backoff"))
