"""Usage, cost and quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quire.operators.fold import carried, grants
from quire.plans.registry import query
from quire.sources.views import EVENTS_ASOF, quotas, usage_logs

#: Price per million tokens in and out, and the default for other models.
PRICES = [("model-0", "0.10", "0.40"), ("model-1", "0.15", "0.60"), ("model-2", "1.25", "10.00"), ("model-3", "0.30", "2.50")]
DEFAULT_PRICE = ("0.10", "0.40")


def call_cost(logs: DataFrame) -> DataFrame:
    """Adds cost, decimal of 6 places, half up; a model without a price takes the default."""
    price = lambda i: F.coalesce(*[F.when(F.col("model") == p[0], F.lit(p[i]).cast("decimal(10,2)")) for p in PRICES], F.lit(DEFAULT_PRICE[i - 1]).cast("decimal(10,2)"))
    sums = F.col("input_tokens").cast("decimal(18,0)") * price(1) + F.col("output_tokens").cast("decimal(18,0)") * price(2)
    return logs.withColumn("cost", F.round(sums.cast("decimal(30,4)") / F.lit(1_000_000), 6).cast("decimal(18,6)"))


def warning_level(used: Column, limit: Column) -> Column:
    """0 to 3 at 70, 90 and 100 per cent of the limit; a limit of 0 or less is blocked."""
    share = used.cast("double") / F.nullif(limit.cast("double"), F.lit(0.0)) * 100
    return F.when(limit <= 0, 3).when(share >= 100, 3).when(share >= 90, 2).when(share >= 70, 1).otherwise(0)


def to_credits(cad: Column) -> Column:
    return F.bround(cad * 100, 0).cast("long")


def running_cost(costs: DataFrame) -> DataFrame:
    """Adds month and used: the user's cost so far in the calendar month.

    Two levels: a running sum within each hour, and the sums of the hours before it, of which a month has 744 at most. A user's
    month thus splits over many tasks, however many calls it has.
    """
    key = ["user_id", "month", "__hour"]
    rows = costs.withColumns({"month": F.date_trunc("month", "ts").cast("date"), "__hour": F.date_trunc("hour", "ts")})
    within = F.sum("cost").over(W.partitionBy(*key).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    hours = rows.groupBy(*key).agg(F.sum("cost").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy("user_id", "month").orderBy("__hour").rowsBetween(W.unboundedPreceding, -1))
    hours = hours.select(*[F.col(c).alias(f"__{c}") for c in key], before.alias("__before"))
    local = rows.withColumn("used", within)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    kind = local.schema["used"].dataType
    both = local.join(hours.hint("merge"), same)
    return both.withColumn("used", F.coalesce(F.col("used") + F.col("__before"), "used").cast(kind)).drop("__hour", "__before", *[f"__{c}" for c in key])


def charges(costs: DataFrame, limits: DataFrame) -> DataFrame:
    """Each charge against its user's limit; a charge is booked even if it blocks."""
    rows = running_cost(costs).join(limits, "user_id", "left")
    limit = F.coalesce("monthly_limit", F.lit("15.00").cast("decimal(10,4)"))
    level = warning_level(F.col("used"), limit)
    return rows.select("event_id", "user_id", "month", "used", limit.alias("monthly_limit"), (level < 3).alias("allowed"), F.greatest(F.lit(0), limit - F.col("used")).cast("double").alias("remaining"), level.alias("level"), "ts")


def hourly_bucket(logs: DataFrame, cost: Column, size: int = 100, seconds: int = 3600) -> DataFrame:
    """Per call: granted or refused against a bucket that refills when the first use lies over an hour back.

    One pass over a user's calls in order; a refused call costs nothing.
    """

    calls = logs.select("user_id", "event_id", F.unix_micros("ts").alias("us"), cost.cast("long").alias("cost"))
    run = lambda state, part: grants(part["us"].to_numpy(), part["cost"].to_numpy(), state, size, seconds * 1_000_000)
    return carried(calls, "user_id", ["us", "event_id"], run, "granted", T.BooleanType()).select("user_id", "event_id", "granted")


def _costs(spark, d):
    return call_cost(usage_logs(spark, d))


_ASOF = f"TIMESTAMP '{EVENTS_ASOF}'"
_USED = "sum(cost) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_LEVEL = "CASE WHEN {l} <= 0 THEN 3 WHEN CAST({u} AS DOUBLE) / nullif(CAST({l} AS DOUBLE), 0) * 100 >= 100 THEN 3 WHEN CAST({u} AS DOUBLE) / nullif(CAST({l} AS DOUBLE), 0) * 100 >= 90 THEN 2 WHEN CAST({u} AS DOUBLE) / nullif(CAST({l} AS DOUBLE), 0) * 100 >= 70 THEN 1 ELSE 0 END"


@query("call_cost", "SELECT event_id, model, CAST(cost AS DOUBLE) AS cost FROM costs")
def q_call_cost(spark, d):
    return _costs(spark, d).select("event_id", "model", F.col("cost").cast("double").alias("cost"))


@query("to_credits", "SELECT event_id, CAST(round_even(cost * 100, 0) AS BIGINT) AS credits, CAST(round_even(cost * 100, 0) AS DOUBLE) / 100 AS cad FROM costs")
def q_to_credits(spark, d):
    c = to_credits(F.col("cost"))
    return _costs(spark, d).select("event_id", c.alias("credits"), (c.cast("double") / 100).alias("cad"))


@query("running_month_cost", f"SELECT event_id, user_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST({_USED} AS DOUBLE) AS used FROM costs")
def running_month_cost(spark, d):
    return running_cost(_costs(spark, d)).select("event_id", "user_id", "month", F.col("used").cast("double").alias("used"))


@query("consume_cost", f"SELECT event_id, {_LEVEL.format(l='monthly_limit', u='used')} < 3 AS allowed, round(CAST(greatest(0, monthly_limit - used) AS DOUBLE), 6) AS remaining, {_LEVEL.format(l='monthly_limit', u='used')} AS level FROM (SELECT *, {_USED} AS used FROM costs) JOIN quotas USING (user_id)")
def consume_cost(spark, d):
    return charges(_costs(spark, d), quotas(spark, d)).select("event_id", "allowed", F.round("remaining", 6).alias("remaining"), "level")


@query("warning_level", f"SELECT user_id, {_LEVEL.format(l='monthly_limit', u='used')} AS level FROM (SELECT user_id, sum(cost) AS used FROM costs GROUP BY 1) JOIN quotas USING (user_id)")
def q_warning_level(spark, d):
    used = _costs(spark, d).groupBy("user_id").agg(F.sum("cost").alias("used"))
    return used.join(quotas(spark, d), "user_id").select("user_id", warning_level(F.col("used"), F.col("monthly_limit")).alias("level"))


@query("max_warning_level", f"SELECT event_id, max({_LEVEL.format(l='monthly_limit', u='used')}) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS level FROM (SELECT *, {_USED} AS used FROM costs) JOIN quotas USING (user_id)")
def max_warning_level(spark, d):
    order = W.partitionBy("user_id", "month").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return charges(_costs(spark, d), quotas(spark, d)).select("event_id", F.max("level").over(order).alias("level"))


@query("credit_status", f"""SELECT user_id, CAST(round_even(coalesce(used, 0) * 100, 0) AS BIGINT) AS credits_used, CAST(monthly_limit * 100 AS BIGINT) AS credits_limit, greatest(0, CAST(monthly_limit * 100 AS BIGINT) - CAST(round_even(coalesce(used, 0) * 100, 0) AS BIGINT)) AS credits_remaining,
    round(CASE WHEN monthly_limit <= 0 THEN 100.0 ELSE least(100.0, CAST(coalesce(used, 0) AS DOUBLE) / CAST(monthly_limit AS DOUBLE) * 100) END, 6) AS percentage, DATE '2024-02-01' AS reset_date, 1 AS days_until_reset
    FROM quotas LEFT JOIN (SELECT user_id, sum(cost) AS used FROM costs WHERE ts >= date_trunc('month', {_ASOF}) AND ts <= {_ASOF} GROUP BY 1) USING (user_id)""")
def credit_status(spark, d, asof: str = EVENTS_ASOF):
    now = F.lit(asof).cast("timestamp")
    used = _costs(spark, d).where((F.col("ts") >= F.date_trunc("month", now)) & (F.col("ts") <= now)).groupBy("user_id").agg(F.sum("cost").alias("used"))
    rows = quotas(spark, d).join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("decimal(18,6)")))
    u, limit = to_credits(F.col("used")), to_credits(F.col("monthly_limit"))
    share = F.when(F.col("monthly_limit") <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.col("used").cast("double") / F.nullif(F.col("monthly_limit").cast("double"), F.lit(0.0)) * 100))
    reset = F.add_months(F.trunc(now, "MM"), 1)
    return rows.select("user_id", u.alias("credits_used"), limit.alias("credits_limit"), F.greatest(F.lit(0), limit - u).alias("credits_remaining"), F.round(share, 6).alias("percentage"), reset.alias("reset_date"), F.datediff(reset, now).alias("days_until_reset"))


@query("usage_summary", f"SELECT user_id, operation_type, CAST(sum(cost) AS DOUBLE) AS cost, CAST(round_even(sum(cost) * 100, 0) AS BIGINT) AS credits, sum(input_tokens + output_tokens)::BIGINT AS tokens, count(*) AS calls FROM costs WHERE ts >= {_ASOF} - INTERVAL 30 DAY GROUP BY 1, 2")
def usage_summary(spark, d, asof: str = EVENTS_ASOF, days: int = 30):
    since = F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return _costs(spark, d).where(F.col("ts") >= since).groupBy("user_id", "operation_type").agg(F.sum("cost").cast("double").alias("cost"), to_credits(F.sum("cost")).alias("credits"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count(F.lit(1)).alias("calls"))


@query("usage_history", "SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(cost) AS DOUBLE) AS cost, CAST(round_even(sum(cost) * 100, 0) AS BIGINT) AS credits, count(*) AS calls FROM costs GROUP BY 1, 2")
def usage_history(spark, d):
    return _costs(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("cost").cast("double").alias("cost"), to_credits(F.sum("cost")).alias("credits"), F.count(F.lit(1)).alias("calls"))


@query("token_usage", "SELECT user_id AS run, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM usage_logs GROUP BY 1")
def token_usage(spark, d):
    return usage_logs(spark, d).groupBy(F.col("user_id").alias("run")).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


HOURLY_BUCKET = """WITH RECURSIVE calls AS (SELECT user_id, event_id, ts, event_id % 60 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    bucket AS (SELECT user_id, i, event_id, ts AS since, CASE WHEN 100 >= cost THEN 100 - cost ELSE 100 END AS left_over, 100 >= cost AS granted FROM calls WHERE i = 1
    UNION ALL SELECT c.user_id, c.i, c.event_id, CASE WHEN epoch_us(c.ts) - epoch_us(b.since) > 3600000000 THEN c.ts ELSE b.since END,
    CASE WHEN (CASE WHEN epoch_us(c.ts) - epoch_us(b.since) > 3600000000 THEN 100 ELSE b.left_over END) >= c.cost THEN (CASE WHEN epoch_us(c.ts) - epoch_us(b.since) > 3600000000 THEN 100 ELSE b.left_over END) - c.cost ELSE b.left_over END,
    (CASE WHEN epoch_us(c.ts) - epoch_us(b.since) > 3600000000 THEN 100 ELSE b.left_over END) >= c.cost FROM bucket b JOIN calls c ON c.user_id = b.user_id AND c.i = b.i + 1)
    SELECT user_id, event_id, granted FROM bucket"""


@query("hourly_credit_bucket", HOURLY_BUCKET)
def hourly_credit_bucket(spark, d):
    return hourly_bucket(usage_logs(spark, d), F.col("event_id") % 60)


@query("plan_limits", "SELECT user_id, plan, CASE plan WHEN 'premium' THEN 500 WHEN 'pro' THEN 200 ELSE 100 END AS hourly_limit FROM quotas")
def plan_limits(spark, d):
    return quotas(spark, d).select("user_id", "plan", F.when(F.col("plan") == "premium", 500).when(F.col("plan") == "pro", 200).otherwise(100).alias("hourly_limit"))


@query("backfill_limits", "SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 15.0 ELSE CAST(monthly_limit AS DOUBLE) END AS monthly_limit FROM quotas")
def backfill_limits(spark, d, old: float = 50.0, new: float = 15.0):
    """The old default gives way to the new one; other limits stay."""
    rows = quotas(spark, d).select("user_id", F.when(F.col("user_id") % 7 == 0, F.lit(old)).otherwise(F.col("monthly_limit").cast("double")).alias("monthly_limit"))
    return rows.withColumn("monthly_limit", F.when(F.col("monthly_limit") == old, new).otherwise(F.col("monthly_limit")))
