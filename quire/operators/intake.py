"""Mail intake and its job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.sources.views import ORDERS_ASOF, email_jobs, emails, endpoints, senders, users

#: Lower-case marks before which a forwarded message's instructions stand.
FORWARD_MARKS = ("---------- forwarded message", "begin forwarded message:", "-----original message-----")


def normalize_email(address: Column) -> Column:
    return F.lower(F.trim(F.coalesce(address, F.lit(""))))


def instruction_text(body: Column, most: int = 2000) -> Column:
    """What stands before the first forward mark; the whole body if that is under 10 characters."""
    low = F.lower(body)
    at = F.least(*[F.nullif(F.instr(low, F.lit(m)), F.lit(0)) for m in FORWARD_MARKS])
    trim = lambda x: F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    head = trim(F.substring(body, F.lit(1), F.coalesce(at - 1, F.length(body))))
    return F.substring(F.when(F.length(head) < 10, trim(body)).otherwise(head), 1, most)


def match_endpoint(mails: DataFrame, known: DataFrame) -> DataFrame:
    """email_id, alias of the first recipient that is a known alias. The smaller alias table meets exploded recipients."""
    to = mails.select("email_id", F.posexplode("recipients").alias("pos", "r")).withColumn("alias", normalize_email(F.col("r")))
    hits = to.join(known.select("alias").hint("merge"), "alias")
    return hits.groupBy("email_id").agg(F.min_by("alias", "pos").alias("alias"))


def decide(mails: DataFrame, known: DataFrame, verified: DataFrame) -> DataFrame:
    """email_id, received_at, decision: the first rule of the cascade that holds."""
    seen = F.row_number().over(W.partitionBy("message_id").orderBy("received_at", "email_id")) > 1
    rows = mails.withColumn("again", seen).withColumn("who", normalize_email(F.col("sender"))).join(match_endpoint(mails, known).hint("merge"), "email_id", "left")
    rows = rows.join(known.hint("merge"), "alias", "left")
    ok = verified.where("status = 'verified'").select("user_id", F.col("email").alias("who"), F.lit(True).alias("known_sender"))
    rows = rows.join(ok.hint("merge"), ["user_id", "who"], "left")
    cascade = (
        F.when(F.col("again"), "duplicate").when(F.col("user_id").isNull(), "unknown_alias").when(F.col("default_agent").isNull(), "invalid_endpoint").when(~F.col("is_active"), "inactive_alias")
        .when(F.col("known_sender").isNull(), "unverified_sender").when(F.col("user_id") % 13 == 0, "credit_limited").when(F.length("body") < 40, "discarded").otherwise("accepted")
    )
    return rows.select("email_id", "received_at", cascade.alias("decision"))


def attachment_reasons(files: Column, total_limit: int = 52428800, each_limit: int = 26214400, most: int = 10) -> Column:
    """For each of the first ten of an array of sizes: why it is skipped, or a blank text if it is kept."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        reason = F.when(size > each_limit, "too large").when(s["total"] + size > total_limit, "total size exceeded").when(size == 0, "empty").otherwise("")
        return F.struct((s["total"] + F.when(reason == "", size).otherwise(0)).alias("total"), F.concat(s["out"], F.array(reason)).alias("out"))

    return F.aggregate(F.slice(files, 1, most), start, step, lambda s: s["out"])


def select_attachments(files: Column, total_limit: int = 52428800, each_limit: int = 26214400, most: int = 10) -> Column:
    """Indexes kept of an array of sizes: of the first ten, those that are not empty, not too large, and still fit the total."""
    reasons = F.transform(attachment_reasons(files, total_limit, each_limit, most), lambda r, i: F.when(r == "", i))
    return F.filter(reasons, lambda i: i.isNotNull())


@query("normalize_email", "SELECT email_id, lower(trim(coalesce(sender, ''))) AS sender FROM emails")
def q_normalize_email(spark, d):
    return emails(spark, d).select("email_id", normalize_email(F.col("sender")).alias("sender"))


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_MARKS = ", ".join(f"nullif(instr(lower(body), '{m}'), 0)" for m in FORWARD_MARKS)


@query("instruction_text", f"SELECT email_id, substr(CASE WHEN length(head) < 10 THEN trim(body, {_WS}) ELSE head END, 1, 2000) AS instruction FROM (SELECT email_id, body, trim(substr(body, 1, coalesce(least({_MARKS}) - 1, length(body))), {_WS}) AS head FROM emails)")
def q_instruction_text(spark, d):
    return emails(spark, d).select("email_id", instruction_text(F.col("body")).alias("instruction"))


@query("match_endpoint", "SELECT email_id, alias FROM emails JOIN endpoints ON alias IN (lower(recipients[1]), lower(recipients[2]))")
def q_match_endpoint(spark, d):
    return match_endpoint(emails(spark, d), endpoints(spark, d))


@query("intake_decision", "SELECT email_id, decision FROM decisions")
def intake_decision(spark, d):
    return decide(emails(spark, d), endpoints(spark, d), senders(spark, d)).drop("received_at")


@query("poll_summary", "SELECT count(*) AS seen, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'duplicate') AS duplicates, count(*) FILTER (decision IN ('unknown_alias', 'invalid_endpoint', 'inactive_alias')) AS ignored, count(*) FILTER (decision IN ('unverified_sender', 'credit_limited', 'discarded')) AS discarded, max(received_at) AS high_water FROM decisions")
def poll_summary(spark, d):
    n = lambda *k: F.count_if(F.col("decision").isin(*k))
    rows = decide(emails(spark, d), endpoints(spark, d), senders(spark, d))
    return rows.agg(F.count(F.lit(1)).alias("seen"), n("accepted").alias("accepted"), n("duplicate").alias("duplicates"), n("unknown_alias", "invalid_endpoint", "inactive_alias").alias("ignored"), n("unverified_sender", "credit_limited", "discarded").alias("discarded"), F.max("received_at").alias("high_water"))


_SIZE = "CASE WHEN (email_id + i) % 7 = 0 THEN 0 ELSE ((email_id * 31 + i * 17) % 30) * 1048576 END"


_WHY = "CASE WHEN a.size > 26214400 THEN 'too large' WHEN f.total + a.size > 52428800 THEN 'total size exceeded' WHEN a.size = 0 THEN 'empty' ELSE '' END"


@query("select_attachments", f"""WITH RECURSIVE a AS (SELECT email_id, i, {_SIZE} AS size FROM (SELECT email_id, unnest(range(12)) AS i FROM emails)),
    f AS (SELECT email_id, -1::BIGINT AS i, '' AS why, 0::BIGINT AS total FROM emails
    UNION ALL SELECT a.email_id, a.i, {_WHY}, f.total + CASE WHEN {_WHY} = '' THEN a.size ELSE 0 END FROM f JOIN a ON a.email_id = f.email_id AND a.i = f.i + 1 WHERE a.i < 10)
    SELECT email_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (why = ''), '') AS kept, coalesce(string_agg(i || ' ' || why, ',' ORDER BY i) FILTER (why <> ''), '') AS skipped FROM f WHERE i >= 0 GROUP BY 1""")
def q_select_attachments(spark, d):
    """What is kept of each message's attachments, and why the others are skipped."""
    e, i = F.col("email_id"), F.sequence(F.lit(0), F.lit(11))
    size = F.transform(i, lambda x: F.when((e + x) % 7 == 0, F.lit(0).cast("long")).otherwise((e * 31 + x * 17) % 30 * 1048576))
    why = F.transform(attachment_reasons(size), lambda r, n: F.when(r != "", F.concat(n.cast("string"), F.lit(" "), r)))
    return emails(spark, d).select("email_id", F.array_join(select_attachments(size), ",").alias("kept"), F.array_join(F.array_compact(why), ",").alias("skipped"))


@query("ingest_summary", """SELECT u.user_id, p.is_active IS NOT NULL AND p.is_active AS enabled, p.alias, p.default_agent, coalesce(s.n, 0) AS verified, coalesce(j.pending, 0) AS pending, coalesce(j.completed, 0) AS completed FROM users u LEFT JOIN endpoints p USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'verified') AS n FROM senders GROUP BY 1) s USING (user_id) LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed FROM email_jobs GROUP BY 1) j USING (user_id)""")
def ingest_summary(spark, d):
    s = senders(spark, d).groupBy("user_id").agg(F.count_if(F.col("status") == "verified").alias("verified"))
    j = email_jobs(spark, d).groupBy("user_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "completed").alias("completed"))
    rows = users(spark, d).select("user_id").join(endpoints(spark, d), "user_id", "left").join(s, "user_id", "left").join(j, "user_id", "left")
    return rows.select("user_id", F.coalesce("is_active", F.lit(False)).alias("enabled"), "alias", "default_agent", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("verified", "pending", "completed")])


@query("rate_limit_24h", """SELECT job_id, n, n < 20 AS allowed FROM (SELECT job_id, count(*) FILTER (status <> 'discarded') OVER (PARTITION BY user_id ORDER BY epoch_us(created_at) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM email_jobs)""")
def rate_limit_24h(spark, d):
    """Jobs of the trailing 24 hours; the lower bound is exclusive."""
    rows = email_jobs(spark, d).withColumn("us", F.unix_micros(F.col("created_at").cast("timestamp")))
    day = W.partitionBy("user_id").orderBy("us").rangeBetween(-(86_400_000_000 - 1), 0)
    return rows.withColumn("n", F.count_if(F.col("status") != "discarded").over(day)).select("job_id", "n", (F.col("n") < 20).alias("allowed"))


@query("verify_sender", f"""SELECT r.request_id, CASE WHEN s.token IS NULL THEN 'invalid' WHEN s.status = 'verified' AND s.user_id % 2 = 0 THEN 'already' WHEN s.expires_at IS NULL THEN 'no_expiry' WHEN s.expires_at < TIMESTAMP '{ORDERS_ASOF}' THEN 'expired' ELSE 'verified' END AS outcome
    FROM (SELECT o_orderkey AS request_id, 'tok' || (o_custkey * 2) AS token FROM orders) r LEFT JOIN senders s USING (token)""")
def verify_sender(spark, d, asof: str = ORDERS_ASOF):
    requests = email_jobs(spark, d).select(F.col("job_id").alias("request_id"), F.concat(F.lit("tok"), F.col("user_id") * 2).alias("token"))
    rows = requests.join(senders(spark, d).withColumn("known", F.lit(True)), "token", "left")
    now = F.lit(asof).cast("timestamp_ntz")
    outcome = F.when(F.col("known").isNull(), "invalid").when((F.col("status") == "verified") & (F.col("user_id") % 2 == 0), "already").when(F.col("expires_at").isNull(), "no_expiry").when(F.col("expires_at") < now, "expired").otherwise("verified")
    return rows.select("request_id", outcome.alias("outcome"))


@query("pending_jobs", "SELECT job_id, created_at FROM email_jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 25")
def pending_jobs(spark, d, n: int = 25):
    return email_jobs(spark, d).where("status = 'pending'").orderBy("created_at", "job_id").limit(n).select("job_id", "created_at")


@query("claim_jobs", "SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM email_jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 25) THEN 'processing' ELSE status END AS status FROM email_jobs")
def claim_jobs(spark, d, n: int = 25):
    """The oldest pending jobs become processing. n bounds what is broadcast."""
    rows = email_jobs(spark, d)
    claimed = rows.where("status = 'pending'").orderBy("created_at", "job_id").limit(n).select("job_id", F.lit(True).alias("claimed"))
    return rows.join(F.broadcast(claimed), "job_id", "left").select("job_id", F.when(F.col("claimed"), "processing").otherwise(F.col("status")).alias("status"))


@query("job_outcomes", "SELECT CASE WHEN status <> 'processing' THEN 'skipped' WHEN job_id % 8 = 0 THEN 'failed' ELSE 'completed' END AS outcome, count(*) AS n FROM email_jobs GROUP BY 1")
def job_outcomes(spark, d):
    outcome = F.when(F.col("status") != "processing", "skipped").when(F.col("job_id") % 8 == 0, "failed").otherwise("completed")
    return email_jobs(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("poll_window", "SELECT email_id FROM emails WHERE received_at >= (SELECT max(received_at) FROM emails WHERE conv_id < 40) - INTERVAL 300 SECOND AND message_id NOT IN (SELECT message_id FROM emails WHERE conv_id < 40)")
def poll_window(spark, d):
    """New messages since the high-water mark less 300 s; those seen before drop out by their id."""
    rows = emails(spark, d)
    seen = rows.where("conv_id < 40")
    mark = seen.agg((F.max("received_at") - F.expr("INTERVAL 300 SECONDS")).alias("since"))
    late = rows.join(F.broadcast(mark), F.col("received_at") >= F.col("since"))  # the mark is one row
    return late.join(seen.select("message_id").distinct(), "message_id", "left_anti").select("email_id")
