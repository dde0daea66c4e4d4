"""Exact rows, invariants and plans."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators import audit, chunk, files, intake, quotes, report, text, usage, vectors
from quire.sources.views import doc_lines, table

DATA = "/root/testdata/sf0.001"


def one(df):
    return df.collect()[0][0]


def test_usage_charges(spark):
    """0.004 and then 0.007 against a limit of 0.01: allowed, then refused and blocked; with 0.02 normal."""
    t = dt.datetime(2024, 1, 5)
    costs = spark.createDataFrame([(1, 7, t, 0.004), (2, 7, t, 0.007)], "event_id long, user_id long, ts timestamp, c double").withColumn("cost", F.col("c").cast("decimal(18,6)"))
    for limit, want in ((0.01, [(True, 0), (False, 3)]), (0.02, [(True, 0), (True, 0)])):
        limits = spark.createDataFrame([(7, limit)], "user_id long, l double").select("user_id", F.col("l").cast("decimal(10,4)").alias("monthly_limit"))
        assert [(r.allowed, r.level) for r in usage.charges(costs, limits).orderBy("event_id").collect()] == want


def test_running_cost_sums_up(spark):
    from quire.sources.views import usage_logs

    costs = usage.call_cost(usage_logs(spark, DATA))
    last = usage.running_cost(costs).groupBy("user_id", "month").agg(F.max("used").alias("used"))
    total = costs.groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.sum("cost").alias("used"))
    assert last.exceptAll(total).isEmpty() and total.exceptAll(last).isEmpty()


def test_windows_rebuild_their_section(spark):
    l1 = chunk.chunk_l1(text.paginate(doc_lines(spark, DATA)))
    for r in l1.limit(30).collect():
        words = r.text.split()
        got = [w for w in chunk.chunk_l2(l1.where((F.col("doc_id") == r.doc_id) & (F.col("chunk") == r.chunk))).orderBy("window_index").collect()] if r.token_count > 1500 else []
        if got:
            assert [x for w in got for x in w.text.split()[80 if w.window_index else 0 :]] == words


def test_spans_rebuild_the_text(spark):
    start, gone, new = audit.change_span(F.col("baseline"), F.col("current"))
    for r in audit.reports(spark, DATA).select("baseline", "current", start.alias("s"), gone.alias("gone"), new.alias("new")).collect():
        assert r.baseline[: r.s] + r.new + r.baseline[r.s + len(r.gone) :] == r.current


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "So wrote Dr. P.N. Cundall, in 1971. Dr. P.N. Cundall again"), (2, "Dr. Cundall"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Dr. P.N. Cundall,"), (10, "")], "quote_id long, text string")
    assert [tuple(r) for r in quotes.quote_match_exact(docs, asked).collect()] == [(9, 1, 2)]


def test_small_rules(spark):
    r = spark.range(1)
    assert one(r.select(files.collection_name(F.lit("u1")))) == "user_u1"
    assert one(r.select(files.collection_name(F.lit("a b")))).startswith("user_") and len(one(r.select(files.collection_name(F.lit("a b"))))) == 61
    assert one(r.select(files.sanitize_filename(F.lit("../a<b>.pdf")))) == "a_b_.pdf"
    assert one(r.select(report.placeholder_name(F.lit("What is the total amount of the contract?")))) == "TotalAmountContract"
    assert one(r.select(report.render_list(F.array(F.lit("a<b"), F.lit("c"))))) == "<li>a&lt;b</li>\n    <li>c</li>"
    assert one(r.select(text.html_to_text(F.lit("<p>a</p><p>b &amp; c</p><script>x</script>")))) == "ab & c"
    assert one(r.select(intake.instruction_text(F.lit("please do this\nBegin forwarded message:\nold")))) == "please do this"
    assert one(r.select(intake.select_attachments(F.array(*[F.lit(x * 1048576) for x in (20, 20, 20, 0, 5)])))) == [0, 1, 4]


def test_embed_failures_are_rows(spark):
    def fails(ts):
        if any("bad" in t for t in ts):
            raise ValueError("no")
        return [[1.0]] * len(ts)

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "ok") for i in range(10)], "id long, text string").coalesce(1)
    got = vectors.embed_batches(rows, fails, 2).collect()
    assert len(got) == 10 and [r.id for r in got if r.error] == [4, 5]


def test_ann_recall(spark):
    from quire.plans.registry import queries

    exact = queries()["vector_topk"](spark, DATA).where("searched = 'all'").select("query_id", "vec_id")
    near = queries()["vector_topk_ann"](spark, DATA).select("query_id", "vec_id")
    assert exact.join(near, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    lines = table(spark, DATA, "documents").select("doc_id")
    assert "text" not in plan(lines).split("ReadSchema")[1]
    from quire.plans.registry import queries

    for name in ("chunk_l2", "dedup_by_hash", "running_month_cost", "intake_decision", "quote_match_exact", "bottleneck"):
        p = plan(queries()[name](spark, DATA))
        assert "Python" not in p and "Cartesian" not in p and "NestedLoop" not in p, name
