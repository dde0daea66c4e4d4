"""Audit trail: baselines, change spans, revisions and snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.sources.views import table


def reports(spark, d) -> DataFrame:
    """conv_id, turn, baseline, current: unchanged, one word replaced, a suffix added or a prefix dropped."""
    t, k = F.col("text"), F.col("turn") % 4
    current = F.when(k == 0, t).when(k == 1, F.replace(t, F.lit(" the "), F.lit(" THE "))).when(k == 2, F.concat(t, F.lit(" (edited)"))).otherwise(F.substring(t, F.lit(8), F.length(t)))
    return table(spark, d, "conversations").select("conv_id", "turn", t.alias("baseline"), current.alias("current"))


_REPORTS = "(SELECT conv_id, turn, text AS baseline, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' the ', ' THE ') WHEN 2 THEN text || ' (edited)' ELSE substr(text, 8) END AS current FROM conversations)"


def change_span(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(start, deleted, inserted): what lies between the common prefix and the common suffix."""
    most = F.least(F.length(old), F.length(new))
    a, b = F.split(old, ""), F.split(new, "")
    differs = F.zip_with(F.slice(a, 1, F.greatest(most, F.lit(1))), F.slice(b, 1, F.greatest(most, F.lit(1))), lambda x, y: ~x.eqNullSafe(y))
    prefix = F.when(most == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, most))
    rest = most - prefix
    back = F.zip_with(F.slice(F.reverse(a), 1, F.greatest(rest, F.lit(1)).cast("int")), F.slice(F.reverse(b), 1, F.greatest(rest, F.lit(1)).cast("int")), lambda x, y: ~x.eqNullSafe(y))
    suffix = F.when(rest == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(back, True), F.lit(0)) - 1, rest))
    at = (prefix + 1).cast("int")
    return prefix.cast("long"), F.substring(old, at, (F.length(old) - prefix - suffix).cast("int")), F.substring(new, at, (F.length(new) - prefix - suffix).cast("int"))


def token_diff(rows: DataFrame) -> DataFrame:
    """conv_id, turn, seq, change_type, text: changes word by word, for answers with several edits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for conv, turn, old, new in zip(df.conv_id, df.turn, df.baseline.fillna(""), df.current.fillna(""), strict=True):
                a, b, seq = old.split(), new.split(), 0
                for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    for kind, words in (("delete", a[i:j]), ("insert", b[k:m])):
                        if op != "equal" and words:
                            out.append((conv, turn, seq, kind, " ".join(words)))
                            seq += 1
            yield pd.DataFrame(out, columns=["conv_id", "turn", "seq", "change_type", "text"])

    return rows.select("conv_id", "turn", "baseline", "current").mapInPandas(run, "conv_id long, turn long, seq long, change_type string, text string")


_P = "len(list_filter(range(1, least(length(baseline), length(current)) + 1), lambda i: substr(baseline, 1, i) = substr(current, 1, i)))"
_S = "len(list_filter(range(1, least(length(baseline), length(current)) - p + 1), lambda i: right(baseline, i) = right(current, i)))"
_SPANS = f"(SELECT conv_id, turn, p AS start, substr(baseline, p + 1, length(baseline) - p - s) AS deleted, substr(current, p + 1, length(current) - p - s) AS inserted FROM (SELECT *, {_S} AS s FROM (SELECT *, {_P} AS p FROM {_REPORTS} WHERE baseline <> current)))"


@query("baseline_answers", "SELECT conv_id, turn, min_by(text, turn) AS answer FROM conversations GROUP BY 1, 2")
def baseline_answers(spark, d):
    return reports(spark, d).groupBy("conv_id", "turn").agg(F.min_by("baseline", "turn").alias("answer"))


@query("answer_changes", f"SELECT conv_id, turn, current FROM {_REPORTS} WHERE baseline <> current")
def answer_changes(spark, d):
    return reports(spark, d).where("baseline <> current").select("conv_id", "turn", "current")


@query("change_spans", f"SELECT conv_id, turn, 'delete' AS change_type, start AS start_offset, start AS end_offset, deleted AS text FROM {_SPANS} WHERE deleted <> '' UNION ALL SELECT conv_id, turn, 'insert', start, start + length(inserted), inserted FROM {_SPANS} WHERE inserted <> ''")
def change_spans(spark, d):
    """Insert and delete spans with offsets in the final text; a delete has no length there."""
    start, gone, new = change_span(F.col("baseline"), F.col("current"))
    rows = reports(spark, d).where("baseline <> current").select("conv_id", "turn", start.alias("s"), gone.alias("gone"), new.alias("new"))
    spans = F.array(F.struct(F.lit("delete").alias("change_type"), F.col("s").alias("start_offset"), F.col("s").alias("end_offset"), F.col("gone").alias("text")), F.struct(F.lit("insert").alias("change_type"), F.col("s").alias("start_offset"), (F.col("s") + F.length("new")).alias("end_offset"), F.col("new").alias("text")))
    return rows.select("conv_id", "turn", F.explode(F.filter(spans, lambda x: x["text"] != "")).alias("x")).select("conv_id", "turn", "x.*")


@query("audit_view", f"SELECT conv_id, turn, current, coalesce(changes, '') AS changes, changes IS NOT NULL AS has_changes FROM {_REPORTS} LEFT JOIN (SELECT conv_id, turn, string_agg(k || '@' || start, ',' ORDER BY start, k) AS changes FROM (SELECT conv_id, turn, start, 'delete' AS k FROM {_SPANS} WHERE deleted <> '' UNION ALL SELECT conv_id, turn, start, 'insert' FROM {_SPANS} WHERE inserted <> '') GROUP BY 1, 2) USING (conv_id, turn)")
def audit_view(spark, d):
    """Each answer with its changes by offset; all in one row, without a join."""
    start, gone, new = change_span(F.col("baseline"), F.col("current"))
    rows = reports(spark, d).select("conv_id", "turn", "baseline", "current", start.alias("s"), gone.alias("gone"), new.alias("new"))
    at = lambda k: F.concat(F.lit(f"{k}@"), F.col("s").cast("string"))
    changes = F.array_join(F.array_compact(F.array(F.when(F.col("gone") != "", at("delete")), F.when(F.col("new") != "", at("insert")))), ",")
    return rows.select("conv_id", "turn", "current", changes.alias("changes"), (changes != "").alias("has_changes"))


@query("merge_change_runs", "SELECT user_id, min(event_id) AS first_event, event_type, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run, event_type")
def merge_change_runs(spark, d):
    """Neighbouring changes of one type become one: runs along each user's events."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("new", (~F.lag("event_type").over(order).eqNullSafe(F.col("event_type"))).cast("int")).withColumn("run", F.sum("new").over(order))
    return rows.groupBy("user_id", "run", "event_type").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).drop("run")


@query("revision_numbers", "SELECT o_orderkey AS save_id, o_custkey AS report_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision_number FROM orders")
def revision_numbers(spark, d):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("save_id"), F.col("o_custkey").alias("report_id"), F.row_number().over(order).cast("long").alias("revision_number"))


@query("replace_changes", f"SELECT conv_id, turn, start, inserted FROM {_SPANS} WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, 0, 'old' FROM conversations WHERE conv_id % 2 = 1")
def replace_changes(spark, d):
    """A report saved again has its new change set only; others keep theirs."""
    start, _, new = change_span(F.col("baseline"), F.col("current"))
    saved = reports(spark, d).where("conv_id % 2 = 0 and baseline <> current").select("conv_id", "turn", start.alias("start"), new.alias("inserted"))
    stored = table(spark, d, "conversations").select("conv_id", "turn", F.lit(0).cast("long").alias("start"), F.lit("old").alias("inserted"))
    again = table(spark, d, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct()
    return stored.join(again, "conv_id", "left_anti").unionByName(saved)


@query("snapshot_audit_log", "SELECT CASE WHEN a.k IS NULL THEN 'INSERT' WHEN b.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation, coalesce(a.k, b.k) AS record_id FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 11 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p <> b.p")
def snapshot_audit_log(spark, d):
    """What changed between two snapshots, by a hash of the row."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    a = o.where("k % 7 <> 0").select("k", F.xxhash64("p").alias("ha"))
    b = o.where("k % 11 <> 0").select("k", F.xxhash64(F.when(F.col("k") % 5 == 0, F.col("p") + 1).otherwise(F.col("p"))).alias("hb"))
    rows = a.join(b, "k", "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
    return rows.select(F.when(F.col("ha").isNull(), "INSERT").when(F.col("hb").isNull(), "DELETE").otherwise("UPDATE").alias("operation"), F.col("k").alias("record_id"))


@query("token_diff")
def q_token_diff(spark, d):
    return token_diff(reports(spark, d).where("baseline <> current"))
