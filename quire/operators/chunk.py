"""Two-level chunking: pages to sections, sections to windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.text import paginate, token_count
from quire.plans.registry import query
from quire.session import new_folder, staged
from quire.sources.views import doc_lines

L1_TARGET, L1_MAX, WINDOW, OVERLAP = 1200, 2000, 512, 80


def ends_cleanly(last_line: Column) -> Column:
    """Not in a table row of one or two bars, and not after a comma."""
    bars = F.length(last_line) - F.length(F.replace(last_line, F.lit("|"), F.lit("")))
    return ~((bars > 0) & (bars < 3)) & ~last_line.endswith(",")


def chunk_l1(pages: DataFrame, target: int = L1_TARGET, most: int = L1_MAX) -> DataFrame:
    """doc_id, chunk, start_page, end_page, token_count, text. A fold over the pages of one document, in order.

    The fold keeps the tokens of the open section, and a list that grows only where a section ends, so that its time is in proportion to the pages.
    """
    last = F.regexp_replace(F.element_at("lines", -1), r"^[ \t\r]+|[ \t\r]+$", "")
    page = F.struct("page_no", token_count(F.col("markdown")).alias("tokens"), ends_cleanly(last).alias("clean"), "markdown")
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    zero, none = F.lit(0), F.array().cast("array<int>")
    start = F.struct(zero.alias("i"), zero.alias("begin"), zero.cast("long").alias("tokens"), none.alias("ends"))

    def step(s: Column, p: Column) -> Column:
        over = (s["tokens"] + p["tokens"] > most) & (s["i"] > s["begin"])
        tokens = F.when(over, p["tokens"]).otherwise(s["tokens"] + p["tokens"])
        close = (tokens >= target) & p["clean"]
        new = F.concat(F.when(over, F.array(s["i"])).otherwise(none), F.when(close, F.array(s["i"] + 1)).otherwise(none))
        begin = F.when(close, s["i"] + 1).when(over, s["i"]).otherwise(s["begin"])
        ends = F.when(over | close, F.concat(s["ends"], new)).otherwise(s["ends"])
        return F.struct((s["i"] + 1).alias("i"), begin.alias("begin"), F.when(close, F.lit(0).cast("long")).otherwise(tokens).alias("tokens"), ends.alias("ends"))

    ends = F.aggregate("pages", start, step, lambda s: F.when(s["begin"] < s["i"], F.concat(s["ends"], F.array(s["i"]))).otherwise(s["ends"]))
    rows = docs.withColumn("ends", ends).select("doc_id", "pages", "ends", F.posexplode("ends").alias("chunk", "end"))
    first = F.when(F.col("chunk") == 0, 0).otherwise(F.get("ends", F.col("chunk") - 1))
    rows = rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.slice("pages", first + 1, F.col("end") - first).alias("p"))
    body = lambda x: F.concat(F.lit("\n--- PAGE "), x["page_no"].cast("string"), F.lit(" ---\n"), x["markdown"], F.lit("\n"))
    number = lambda i: F.element_at("p", i)["page_no"]
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    return rows.select("doc_id", "chunk", number(1).alias("start_page"), number(-1).alias("end_page"), total.alias("token_count"), F.array_join(F.transform("p", body), "").alias("text"))


def chunk_l2(l1: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk, window_index, offset_start, offset_end (inclusive), text, start_page, end_page; no shuffle."""
    stride = window - overlap
    rows = l1.withColumn("w", F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != ""))
    n = F.size("w")
    last = F.when(n <= window, 0).otherwise(F.ceil((n - window) / stride)).cast("int")
    rows = rows.withColumn("window_index", F.explode(F.sequence(F.lit(0), last)))
    at = F.col("window_index") * stride
    return rows.select("doc_id", "chunk", F.col("window_index").cast("long").alias("window_index"), at.cast("long").alias("offset_start"), (F.least(at + window, n) - 1).cast("long").alias("offset_end"), F.array_join(F.slice("w", at + 1, window), " ").alias("text"), "start_page", "end_page")


def _l1(spark, d):
    return chunk_l1(paginate(doc_lines(spark, d)))


@query("ends_cleanly", "SELECT doc_id, page_no, clean FROM page_ends")
def q_ends_cleanly(spark, d):
    last = F.regexp_replace(F.element_at("lines", -1), r"^[ \t\r]+|[ \t\r]+$", "")
    return paginate(doc_lines(spark, d)).select("doc_id", "page_no", ends_cleanly(last).alias("clean"))


@query("chunk_l1", "SELECT doc_id, chunk::BIGINT AS chunk, start_page, end_page, token_count, md5(text) AS text_md5 FROM l1_chunks")
def q_chunk_l1(spark, d):
    return _l1(spark, d).select("doc_id", "chunk", "start_page", "end_page", "token_count", F.md5("text").alias("text_md5"))


@query("chunk_l2", "SELECT doc_id, chunk::BIGINT AS chunk, window_index, offset_start, offset_end, md5(text) AS text_md5 FROM l2_chunks")
def q_chunk_l2(spark, d):
    return chunk_l2(_l1(spark, d)).select("doc_id", "chunk", "window_index", "offset_start", "offset_end", F.md5("text").alias("text_md5"))


@query("chunk_statistics", """SELECT doc_id, level, count(*) AS n, round(avg(t), 6) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens, sum(t)::BIGINT AS total_tokens FROM (
    SELECT doc_id, 1 AS level, token_count AS t FROM l1_chunks UNION ALL SELECT doc_id, 2, length(text) // 4 FROM l2_chunks) GROUP BY GROUPING SETS ((doc_id, level), (level))""")
def chunk_statistics(spark, d):
    l1 = _l1(spark, d)
    both = l1.select("doc_id", F.lit(1).alias("level"), F.col("token_count").alias("t")).unionByName(chunk_l2(l1).select("doc_id", F.lit(2).alias("level"), token_count(F.col("text")).alias("t")))
    return both.groupingSets([[F.col("doc_id"), F.col("level")], [F.col("level")]], "doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t"), 6).alias("avg_tokens"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"), F.sum("t").alias("total_tokens"))


_TABLE_LINE = "(contains({0}, '|') OR (trim({0}) <> '' AND replace(trim({0}), '-', '') = ''))"


@query("table_integrity", f"""SELECT doc_id, chunk, window_index, len(t) > 0 AS table_at_end, len(t) > 0 AND NOT (len(list_filter(t[:2], lambda x: length(x) - length(replace(x, '|', '')) >= 2)) > 0 AND len(list_filter(t, lambda x: trim(x) <> '' AND replace(replace(replace(x, '-', ''), '|', ''), ' ', '') = '')) > 0) AS incomplete
    FROM (SELECT doc_id, chunk, window_index, l[greatest(0, len(l) - 4) + 1 + coalesce(list_max(list_filter(range(1, 5), lambda i: i <= least(4, len(l)) AND NOT {_TABLE_LINE.format('l[greatest(0, len(l) - 4) + i]')})), 0):] AS t FROM (SELECT doc_id, chunk::BIGINT AS chunk, window_index, string_split(text, chr(10)) AS l FROM l2_chunks))""")
def table_integrity(spark, d):
    """Whether a window's last lines, four at most, are a table, and whether it lacks a header or a separator there."""
    line = lambda x: x.contains("|") | ((F.trim(x) != "") & (F.replace(F.trim(x), F.lit("-"), F.lit("")) == ""))
    last = F.slice("l", F.greatest(F.lit(1), F.size("l") - 3), F.lit(4))
    tail = F.aggregate(last, F.array().cast("array<string>"), lambda t, x: F.when(line(x), F.concat(t, F.array(x))).otherwise(F.array().cast("array<string>")))
    rows = chunk_l2(_l1(spark, d)).select("doc_id", "chunk", "window_index", F.split("text", "\n").alias("l")).withColumn("t", tail)
    header = F.exists(F.slice("t", 1, 2), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    separator = F.exists("t", lambda x: (F.trim(x) != "") & x.rlike("^[-| ]*$"))
    return rows.select("doc_id", "chunk", "window_index", (F.size("t") > 0).alias("table_at_end"), ((F.size("t") > 0) & ~(header & separator)).alias("incomplete"))


@query("store_chunks", """SELECT c.doc_id, c.chunk::BIGINT AS chunk, c.window_index, p.token_count AS parent_tokens, p.start_page, p.end_page, contains(p.text, '|') AS has_tables
    FROM l2_chunks c LEFT JOIN l1_chunks p ON p.doc_id = c.doc_id AND p.chunk = c.chunk""")
def store_chunks(spark, d):
    l1 = _l1(spark, d)
    parents = l1.select("doc_id", "chunk", F.col("token_count").alias("parent_tokens"), "start_page", "end_page", F.col("text").contains("|").alias("has_tables"))
    return chunk_l2(l1).select("doc_id", "chunk", "window_index").join(parents.hint("merge"), ["doc_id", "chunk"], "left")


@query("chunk_neighbors", """SELECT a.doc_id, a.chunk::BIGINT AS chunk, a.window_index, b.window_index AS neighbor FROM l2_chunks a JOIN l2_chunks b
    ON a.doc_id = b.doc_id AND a.chunk = b.chunk AND b.window_index BETWEEN a.window_index - 2 AND a.window_index + 2 AND b.window_index <> a.window_index""")
def chunk_neighbors(spark, d):
    """Windows within two places in the same section: their numbers follow from the section's last one, without a self join."""
    rows = chunk_l2(_l1(spark, d)).groupBy("doc_id", "chunk").agg(F.collect_set("window_index").alias("all"))
    near = F.filter(F.transform(F.array(*[F.lit(x) for x in (-2, -1, 1, 2)]), lambda o: F.col("window_index") + o), lambda x: F.array_contains(F.col("all"), x))
    return rows.withColumn("window_index", F.explode("all")).select("doc_id", "chunk", "window_index", F.explode(near).alias("neighbor"))


@query("parent_context", "SELECT c.doc_id, c.chunk::BIGINT AS chunk, c.window_index, md5(p.text) AS parent_md5 FROM l2_chunks c JOIN l1_chunks p ON p.doc_id = c.doc_id AND p.chunk = c.chunk")
def parent_context(spark, d):
    l1 = _l1(spark, d)
    return chunk_l2(l1).select("doc_id", "chunk", "window_index").hint("merge").join(l1.select("doc_id", "chunk", F.md5("text").alias("parent_md5")), ["doc_id", "chunk"])


@query("collection_statistics", """SELECT doc_id % 20 AS user_id, count(*) AS total_chunks, count(DISTINCT doc_id) AS documents, round(avg(length(text) // 4), 6) AS avg_tokens, sum(length(text) // 4)::BIGINT AS total_tokens, min(start_page) AS min_page, max(end_page) AS max_page
    FROM l2_chunks GROUP BY 1""")
def collection_statistics(spark, d):
    t = token_count(F.col("text"))
    return chunk_l2(_l1(spark, d)).groupBy((F.col("doc_id") % 20).alias("user_id")).agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg(t), 6).alias("avg_tokens"), F.sum(t).alias("total_tokens"), F.min("start_page").alias("min_page"), F.max("end_page").alias("max_page"))


def replace_documents(rows: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Write rows of some documents to the table at path, instead of what it has of these documents; the others stay.

    The table is partitioned by a bucket of the key. Only the buckets of the given documents are read and written again, in one job, by dynamic partition overwrite:
    readers see the old files of a bucket or the new ones. The same rows again change nothing. A path that doesn't exist is made.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = staged(rows.withColumn("bucket", bucket), "replacing")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
        gone = rows.select(F.col(key).alias("__key")).distinct()
        kept = old.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        rows = rows.unionByName(staged(kept.select(rows.columns), "kept"))  # a table isn't overwritten while it is read
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of such a table, without the bucket."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).drop("bucket")


@query("reprocess_document", "SELECT doc_id, chunk::BIGINT AS chunk, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'old' END AS version FROM l1_chunks")
def reprocess_document(spark, d):
    """All chunks are written as a table; documents that are processed again replace their own there."""
    chunks = _l1(spark, d).select("doc_id", "chunk")
    path = new_folder(spark, "chunks")
    replace_documents(chunks.withColumn("version", F.lit("old")), path)
    new = chunks.where("doc_id % 10 = 0").withColumn("version", F.lit("new"))
    replace_documents(new, path)
    return read_documents(spark, path, new.schema)


def pack_context(sections: DataFrame, key: str, budget: int = 4000) -> DataFrame:
    """key, sections, tokens, context: of each key the nearest sections, with header and footer, until one would pass the budget.

    sections: key, distance, place (decides between equal distances), source, start_page, end_page, text. A section costs its characters divided by four. A
    null distance comes last, null pages are called N/A. A key whose first section is over the budget has no row.
    """
    nearest = W.partitionBy(key).orderBy(F.asc_nulls_last("distance"), "place")
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    i = F.col("i").cast("string")
    head = F.concat(F.lit("=== DOCUMENT SECTION "), i, F.lit(" ===\nSource: "), F.coalesce("source", F.lit("Document")), F.lit(" (Pages "), page("start_page"), F.lit("-"), page("end_page"), F.lit(")\n"))
    whole = F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n=== END SECTION "), i, F.lit(" ===\n\n"))
    rows = sections.withColumn("i", F.row_number().over(nearest)).withColumn("section", whole).withColumn("t", token_count(F.col("section")))
    rows = rows.withColumn("upto", F.sum("t").over(nearest.rowsBetween(W.unboundedPreceding, 0))).where(F.col("upto") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "section"))), lambda x: x["section"]), "")  # within the budget
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("sections"), F.sum("t").alias("tokens"), text.alias("context"))


@query(
    "pack_context",
    """WITH s AS (SELECT doc_id, chunk, window_index, ((chunk * 7 + window_index * 3) % 11) / 10.0 AS distance, start_page, end_page, text FROM l2_chunks),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, chunk, window_index) AS i FROM s),
    w AS (SELECT doc_id, i, '=== DOCUMENT SECTION ' || i || ' ===' || chr(10) || 'Source: doc_' || doc_id || ' (Pages ' || start_page || '-' || end_page || ')' || chr(10) || text || chr(10) || '=== END SECTION ' || i || ' ===' || chr(10) || chr(10) AS section FROM n),
    u AS (SELECT *, length(section) // 4 AS t, sum(length(section) // 4) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w)
    SELECT doc_id, count(*) AS sections, sum(t)::BIGINT AS tokens, md5(string_agg(section, '' ORDER BY i)) AS context FROM u WHERE upto <= 4000 GROUP BY doc_id""",
)
def q_pack_context(spark, d):
    """Windows of each document by a distance made from their numbers."""
    far = (F.col("chunk") * 7 + F.col("window_index") * 3) % 11 / 10
    place = F.struct("chunk", "window_index")
    rows = chunk_l2(_l1(spark, d)).select("doc_id", far.alias("distance"), place.alias("place"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "start_page", "end_page", "text")
    return pack_context(rows, "doc_id").withColumn("context", F.md5("context"))
