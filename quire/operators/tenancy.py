"""Tenancy and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.views import ORDERS_ASOF, agents, email_jobs, logins, members, orgs, table, users


@query("own_rows", "SELECT job_id FROM (SELECT job_id FROM email_jobs WHERE user_id = 7 ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 2)")
def own_rows(spark, d, user: int = 7, n: int = 20, skip: int = 2):
    return email_jobs(spark, d).where(F.col("user_id") == user).orderBy(F.col("created_at").desc(), "job_id").offset(skip).limit(n).select("job_id")


@query("child_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 7)")
def child_rows(spark, d, user: int = 7):
    own = table(spark, d, "orders").where(F.col("o_custkey") == user).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(own, "l_orderkey", "left_semi")


@query("visible_agents", """SELECT agent_id, 'everyone' AS audience, NULL::BIGINT AS audience_id FROM agents WHERE NOT is_custom UNION ALL SELECT agent_id, 'user', owner_id FROM agents WHERE is_custom UNION ALL SELECT agent_id, 'organisation', org_id FROM agents WHERE is_custom AND org_id IS NOT NULL""")
def visible_agents(spark, d):
    """Who sees each agent, as classes of users: everyone sees prebuilt ones, others their owner and the members of their organisation.

    With the table of members this says all pairs without forming them; see seen_by().
    """
    a = agents(spark, d)
    who = lambda rows, kind, who: rows.select("agent_id", F.lit(kind).alias("audience"), who.cast("long").alias("audience_id"))
    custom = a.where("is_custom")
    return who(a.where(~F.col("is_custom")), "everyone", F.lit(None)).unionByName(who(custom, "user", F.col("owner_id"))).unionByName(who(custom.where("org_id is not null"), "organisation", F.col("org_id")))


def seen_by(visible: DataFrame, member: DataFrame, user: int) -> DataFrame:
    """agent_id of all agents that one user sees."""
    org = [r[0] for r in member.where(F.col("user_id") == user).select("org_id").collect()]  # the organisations of one user
    own = (F.col("audience") == "everyone") | ((F.col("audience") == "user") & (F.col("audience_id") == user)) | ((F.col("audience") == "organisation") & F.col("audience_id").isin(org))
    return visible.where(own).select("agent_id").distinct()


def active_access(rows, member, org):
    """Adds managed and allowed: user, membership and organisation all active, or unmanaged."""
    m = member.select("user_id", "org_id", F.col("status").alias("m_status"))
    o = org.select("org_id", F.col("status").alias("o_status"))
    both = rows.join(m, "user_id", "left").join(o, "org_id", "left")
    managed = F.col("m_status").isNotNull()
    ok = (F.col("status") == "active") & (~managed | ((F.col("m_status") == "active") & (F.col("o_status") == "active")))
    return both.withColumn("managed", managed).withColumn("allowed", F.coalesce(ok, F.lit(False)))


_ACCESS = "SELECT u.user_id, m.status IS NOT NULL AS managed, u.status = 'active' AND (m.status IS NULL OR (m.status = 'active' AND o.status = 'active')) AS allowed FROM users u LEFT JOIN members m USING (user_id) LEFT JOIN orgs o USING (org_id)"


@query("active_access", _ACCESS)
def q_active_access(spark, d):
    return active_access(users(spark, d), members(spark, d), orgs(spark, d)).select("user_id", "managed", "allowed")


@query("session_state", f"""SELECT r.request_id, CASE WHEN s.session_id IS NULL THEN 'unknown' WHEN s.revoked_at IS NOT NULL THEN 'revoked' WHEN s.expires_at <= DATE '2001-08-01' THEN 'expired' WHEN NOT a.allowed THEN 'access_blocked' ELSE 'active' END AS state
    FROM (SELECT o_orderkey AS request_id, o_custkey * 2 AS session_id FROM orders) r LEFT JOIN logins s USING (session_id) LEFT JOIN ({_ACCESS}) a ON a.user_id = s.user_id""")
def session_state(spark, d, asof: str = ORDERS_ASOF):
    requests = email_jobs(spark, d).select(F.col("job_id").alias("request_id"), (F.col("user_id") * 2).alias("session_id"))
    known = logins(spark, d).withColumn("known", F.lit(True))
    access = active_access(users(spark, d), members(spark, d), orgs(spark, d)).select("user_id", "allowed")
    # Sessions meet their users' access first: requests without a session would all meet it under null, in one task.
    rows = requests.join(known.join(access, "user_id", "left").drop("user_id"), "session_id", "left")
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= F.to_date(F.lit(asof)), "expired").when(~F.col("allowed"), "access_blocked").otherwise("active")
    return rows.select("request_id", state.alias("state"))


@query("block_cascade", """SELECT m.org_id, m.user_id, 'blocked' AS status, count(s.session_id) FILTER (s.revoked_at IS NULL) AS revoked_sessions, 'member blocked' AS event, count(s.session_id) FILTER (s.revoked_at IS NULL) || ' sessions revoked' AS detail FROM members m LEFT JOIN logins s USING (user_id) WHERE m.user_id % 23 = 0 GROUP BY 1, 2""")
def block_cascade(spark, d):
    """Blocked members, with the number of open sessions that the block revokes and the audit event that records both."""
    blocked = members(spark, d).where("user_id % 23 = 0").select("org_id", "user_id")
    n = F.count_if(F.col("session_id").isNotNull() & F.col("revoked_at").isNull())
    rows = blocked.join(logins(spark, d), "user_id", "left").groupBy("org_id", "user_id").agg(F.lit("blocked").alias("status"), n.alias("revoked_sessions"))
    return rows.withColumns({"event": F.lit("member blocked"), "detail": F.concat(F.col("revoked_sessions").cast("string"), F.lit(" sessions revoked"))})


_LOGIN_FEED = "SELECT o_orderkey AS login_id, 'iss|' || (o_custkey * 2) AS subject, 'obj|' || CASE WHEN o_orderkey % 20 = 0 THEN o_custkey * 2 + 2 ELSE o_custkey * 2 END AS object FROM orders"
_KNOWN = "SELECT c_custkey AS user_id, 'iss|' || c_custkey AS subject, CASE WHEN c_custkey % 6 <> 0 THEN 'obj|' || c_custkey END AS object FROM customer"


@query("identity_merge", f"""SELECT l.login_id, CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL AND a.user_id <> b.user_id THEN 'conflict' WHEN coalesce(a.user_id, b.user_id) IS NOT NULL THEN 'known' ELSE 'new' END AS verdict,
    CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL AND a.user_id <> b.user_id THEN NULL ELSE coalesce(a.user_id, b.user_id) END AS user_id FROM ({_LOGIN_FEED}) l LEFT JOIN ({_KNOWN}) a ON a.subject = l.subject LEFT JOIN ({_KNOWN}) b ON b.object = l.object""")
def identity_merge(spark, d):
    k, c = F.col("job_id"), F.col("user_id") * 2
    feed = email_jobs(spark, d).select(k.alias("login_id"), F.concat(F.lit("iss|"), c).alias("subject"), F.concat(F.lit("obj|"), F.when(k % 20 == 0, c + 2).otherwise(c)).alias("object"))
    u = F.col("c_custkey")
    known = table(spark, d, "customer").select(u.alias("user_id"), F.concat(F.lit("iss|"), u).alias("subject"), F.when(u % 6 != 0, F.concat(F.lit("obj|"), u)).alias("object"))
    rows = feed.join(known.select(F.col("user_id").alias("a"), "subject"), "subject", "left").join(known.select(F.col("user_id").alias("b"), "object").where("object is not null"), "object", "left")
    clash = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    found = F.coalesce("a", "b")
    return rows.select("login_id", F.when(clash, "conflict").when(found.isNotNull(), "known").otherwise("new").alias("verdict"), F.when(~clash, found).alias("user_id"))


@query("organisation_users", "SELECT m.org_id, u.user_id, u.name, m.role, m.status, l.expires_at AS last_login FROM members m JOIN users u USING (user_id) LEFT JOIN logins l USING (user_id) WHERE m.org_id = 3")
def organisation_users(spark, d, org: int = 3):
    rows = members(spark, d).where(F.col("org_id") == org).join(users(spark, d).select("user_id", "name"), "user_id")
    return rows.join(logins(spark, d).select("user_id", F.col("expires_at").alias("last_login")), "user_id", "left").orderBy("name").select("org_id", "user_id", "name", "role", "status", "last_login")
