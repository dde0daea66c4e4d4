"""Lines, pages and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.sources.views import LINES_PER_PAGE, doc_lines, table


def paginate(lines: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, page_no (from 1), markdown, lines."""
    page = (F.floor(F.col("line_no") / lines_per_page) + 1).cast("long")
    rows = lines.groupBy("doc_id", page.alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.transform("l", lambda x: x["line"])
    return rows.select("doc_id", "page_no", F.array_join(text, "\n").alias("markdown"), text.alias("lines"))


def token_count(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def table_line(line: Column) -> Column:
    """A line of a table: it holds a bar, or only dashes."""
    return line.contains("|") | F.trim(line).rlike("^-+$")


def blocks(lines: DataFrame, inside: Column) -> DataFrame:
    """Runs of lines with inside true on a page: doc_id, page_no, start_line, end_line, content."""
    page = (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("long")
    order = W.partitionBy("doc_id", "page_no").orderBy("line_no")
    rows = lines.withColumn("page_no", page).withColumn("inside", inside)
    rows = rows.withColumn("run", F.sum((~F.col("inside")).cast("int")).over(order)).where("inside")
    out = rows.groupBy("doc_id", "page_no", "run").agg(F.min("line_no").cast("long").alias("start_line"), F.max("line_no").cast("long").alias("end_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select("doc_id", "page_no", "start_line", "end_line", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


TAGS = [(r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?s)<[^>]*>", "")]
#: Entities, decoded in this order so that an escaped ampersand stays one.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """Visible text: tags go without a separator, entities are decoded, blanks collapse."""
    out = html
    for pattern, by in TAGS:
        out = F.regexp_replace(out, pattern, by)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))


def merge_intervals(rows: DataFrame, key: list[str], lo: str, hi: str, tolerance: float) -> DataFrame:
    """Per key, intervals whose gap is within tolerance joined: key, lo, hi, n."""
    order = W.partitionBy(*key).orderBy(lo, hi)
    before = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col(lo) - before > tolerance, F.lit(True)).cast("int")
    runs = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*key, "__run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__run")


@query("split_lines", "SELECT doc_id, line_no, line FROM doc_lines")
def split_lines(spark, d):
    return doc_lines(spark, d).withColumn("line_no", F.col("line_no").cast("long"))


@query("paginate", "SELECT doc_id, page_no, markdown FROM doc_pages")
def q_paginate(spark, d):
    return paginate(doc_lines(spark, d)).select("doc_id", "page_no", "markdown")


@query("count_tokens", "SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens, greatest(1, length(coalesce(text, '')) // 4) AS ocr_tokens FROM documents")
def count_tokens(spark, d):
    n = token_count(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", n.alias("tokens"), F.greatest(F.lit(1), n).cast("long").alias("ocr_tokens"))


@query("estimate_embed_tokens", "SELECT doc_id // 100 AS batch, CAST(floor(sum(length(coalesce(text, ''))) * 0.25) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def estimate_embed_tokens(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 100).cast("long").alias("batch")).agg(F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) * 0.25).cast("long").alias("tokens"))


@query("table_line_flag", "SELECT doc_id, line_no, contains(line, '|') OR regexp_full_match(trim(line), '-+') AS is_table FROM doc_lines")
def table_line_flag(spark, d):
    return doc_lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), table_line(F.col("line")).alias("is_table"))


_BLOCKS = """SELECT doc_id, page_no, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS content FROM (
    SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS run
    FROM (SELECT *, line_no // 5 + 1 AS page_no, {} AS inside FROM doc_lines)) WHERE inside GROUP BY doc_id, page_no, run"""


@query("table_blocks", _BLOCKS.format("contains(line, '|') OR regexp_full_match(trim(line), '-+')"))
def table_blocks(spark, d):
    return blocks(doc_lines(spark, d), table_line(F.col("line")))


@query("paragraph_blocks", _BLOCKS.format("trim(line) <> ''"))
def paragraph_blocks(spark, d):
    return blocks(doc_lines(spark, d), F.trim("line") != "")


@query("squash_rules", """SELECT doc_id, line_no, line FROM (SELECT *, rule AND coalesce(lag(rule) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS gone FROM (
    SELECT *, length(line) > 0 AND (length(line) - length(replace(line, '-', ''))) >= 0.65 * length(line) AS rule FROM doc_lines)) WHERE NOT gone""")
def squash_rules(spark, d):
    n = F.length("line")
    rule = (n > 0) & (n - F.length(F.replace("line", F.lit("-"), F.lit(""))) >= 0.65 * n)
    rows = doc_lines(spark, d).withColumn("rule", rule)
    gone = F.col("rule") & F.coalesce(F.lag("rule").over(W.partitionBy("doc_id").orderBy("line_no")), F.lit(False))
    return rows.withColumn("gone", gone).where("not gone").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("page_markers", """SELECT doc_id, page_no, upto - n AS start_position, upto AS end_position, n AS content_length FROM (SELECT doc_id, page_no, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page_no)::BIGINT AS upto
    FROM (SELECT doc_id, page_no, length(chr(10) || '--- PAGE ' || page_no || ' ---' || chr(10) || markdown || chr(10)) AS n FROM doc_pages))""")
def page_markers(spark, d):
    piece = F.concat(F.lit("\n--- PAGE "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("markdown"), F.lit("\n"))
    rows = paginate(doc_lines(spark, d)).withColumn("content_length", F.length(piece).cast("long"))
    upto = F.sum("content_length").over(W.partitionBy("doc_id").orderBy("page_no"))
    return rows.withColumn("end_position", upto).select("doc_id", "page_no", (F.col("end_position") - F.col("content_length")).alias("start_position"), "end_position", "content_length")


@query("doc_statistics", """SELECT p.doc_id, p.pages, p.tokens, coalesce(t.n, 0) AS tables, coalesce(g.n, 0) AS paragraphs FROM (SELECT doc_id, count(*) AS pages, sum(token_count)::BIGINT AS tokens FROM page_tokens GROUP BY 1) p
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM (%s) GROUP BY 1) t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM (%s) GROUP BY 1) g USING (doc_id)""" % (_BLOCKS.format("contains(line, '|') OR regexp_full_match(trim(line), '-+')"), _BLOCKS.format("trim(line) <> ''")))  # fmt: skip
def doc_statistics(spark, d):
    lines = doc_lines(spark, d)
    pages = paginate(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(token_count(F.col("markdown"))).alias("tokens"))
    count = lambda flag, name: blocks(lines, flag).groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = pages.join(count(table_line(F.col("line")), "tables").hint("merge"), "doc_id", "left").join(count(F.trim("line") != "", "paragraphs").hint("merge"), "doc_id", "left")
    return out.fillna(0, ["tables", "paragraphs"])


@query("doc_preview", """SELECT doc_id, string_agg(CASE WHEN page_no <= 3 THEN CASE WHEN length(markdown) > 500 THEN left(markdown, 500) || '...' ELSE markdown END END, chr(10) ORDER BY page_no) AS preview,
    count(*) AS total_pages, sum(token_count)::BIGINT AS total_tokens FROM page_tokens GROUP BY doc_id""")
def doc_preview(spark, d):
    short = F.when(F.length("markdown") > 500, F.concat(F.substring("markdown", 1, 500), F.lit("..."))).otherwise(F.col("markdown"))
    first = F.array_sort(F.collect_list(F.when(F.col("page_no") <= 3, F.struct("page_no", short.alias("s")))))
    out = paginate(doc_lines(spark, d)).groupBy("doc_id").agg(first.alias("p"), F.count(F.lit(1)).alias("total_pages"), F.sum(token_count(F.col("markdown"))).alias("total_tokens"))
    return out.select("doc_id", F.array_join(F.transform("p", lambda x: x["s"]), "\n").alias("preview"), "total_pages", "total_tokens")


def _oracle_html() -> str:
    out = "html"
    out = rf"regexp_replace({out}, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '(?is)<template\b[^>]*>.*?</template\s*>', '', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({out}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query("html_to_text", f"SELECT page_id, {_oracle_html()} AS text FROM pages")
def q_html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query("html_page_estimate", f"SELECT page_id, n AS chars, CAST(greatest(1, ceil(n / 1800.0)) AS BIGINT) AS pages, ceil(n / 1800.0) <= 5 AND strlen(html) <= 10485760 AS valid FROM (SELECT page_id, html, length({_oracle_html()}) AS n FROM pages)")
def html_page_estimate(spark, d):
    n = F.length(html_to_text(F.col("html"))).cast("long")
    rows = table(spark, d, "pages").select("page_id", n.alias("chars"), F.octet_length("html").alias("size"))
    pages = F.ceil(F.col("chars") / 1800)
    return rows.select("page_id", "chars", F.greatest(F.lit(1), pages).cast("long").alias("pages"), ((pages <= 5) & (F.col("size") <= 10485760)).alias("valid"))


_MERGE = """SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR lo - prev > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi, event_id) AS run FROM (
    SELECT user_id, event_id, value AS lo, value + event_id % 5 AS hi, max(value + event_id % 5) OVER (PARTITION BY user_id ORDER BY value, value + event_id % 5, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)) GROUP BY user_id, run"""


@query("merge_intervals", _MERGE)
def q_merge_intervals(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("lo0"), (F.col("value") + F.col("event_id") % 5).alias("hi0"))
    return merge_intervals(rows, ["user_id"], "lo0", "hi0", 2.0)


@query("cluster_columns", """SELECT page, count(*) AS n, round(median(x), 6) AS center FROM (SELECT *, sum(CASE WHEN prev IS NULL OR x - prev > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x, event_id) AS run FROM (
    SELECT user_id AS page, event_id, value AS x, lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS prev FROM events)) GROUP BY page, run""")
def cluster_columns(spark, d):
    order = W.partitionBy("page").orderBy("x", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), "event_id", F.col("value").alias("x"))
    rows = rows.withColumn("new", F.coalesce(F.col("x") - F.lag("x").over(order) > 2.0, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    return rows.groupBy("page", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("center")).drop("run")
