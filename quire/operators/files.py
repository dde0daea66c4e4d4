"""Files: scanning, checking, classifying, storing and deduplicating uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.sources.views import EVENTS_ASOF, LINES_PER_PAGE, email_jobs, files, table

ALLOWED = ("pdf", "docx", "doc", "txt")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; null without a dot."""
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))


def file_type(name: Column) -> Column:
    e = extension(name)
    return F.when(e.isin(*ALLOWED), e).otherwise("unknown")


def collection_name(user: Column) -> Column:
    """user_<id> where that is a safe key of 3 to 63 characters, else a hash of it."""
    plain = F.concat(F.lit("user_"), user)
    return F.when(plain.rlike("^[A-Za-z0-9][A-Za-z0-9_-]{1,61}[A-Za-z0-9]$"), plain).otherwise(F.concat(F.lit("user_"), F.substring(F.sha2(user, 256), 1, 56)))


def sanitize_filename(name: Column) -> Column:
    """The last part of a path without dangerous marks, and without dots and blanks around it; 255 characters at most, the extension kept."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r'[<>:"|?*\\]', "_")
    base = F.regexp_replace(base, r"^[. ]+|[. ]+$", "")
    ext = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    short = F.concat(F.substring(base, F.lit(1), F.greatest(255 - F.length(ext), F.lit(0))), ext)
    return F.when(F.coalesce(name, F.lit("")) == "", "unnamed_file").when(base == "", "sanitized_file").when(F.length(base) > 255, short).otherwise(base)


def messages(*checks: tuple[Column, str]) -> Column:
    """The texts of the checks that hold, comma-joined in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks])), ",")


def dedup_by_hash(rows: DataFrame) -> DataFrame:
    """Adds original_file_id: the user's first earlier file of the same content that did not fail."""
    before = W.partitionBy("user_id", "content_hash").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    first = F.first(F.when(F.col("status") != "failed", F.col("file_id")), ignorenulls=True).over(before)
    return rows.withColumn("original_file_id", F.when(F.col("status") != "failed", first))


def _hashed(spark, d):
    return files(spark, d).withColumn("content_hash", F.sha2("content", 256))


_H = "(SELECT *, sha256(content) AS content_hash FROM files)"
_EXT = "CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) END"
_DUP = f"(SELECT *, CASE WHEN status <> 'failed' THEN first_value(CASE WHEN status <> 'failed' THEN file_id END IGNORE NULLS) OVER (PARTITION BY user_id, content_hash ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS original_file_id FROM {_H})"


@query("scan_documents", f"SELECT file_id, name, strlen(content) AS size, content_hash, status FROM {_H}")
def scan_documents(spark, d):
    return _hashed(spark, d).select("file_id", "name", F.octet_length("content").cast("long").alias("size"), "content_hash", "status")


@query("storage_path", f"SELECT file_id, 'user_' || user_id || '/report_' || (file_id % 7) || '/' || content_hash || '.pdf' AS path FROM {_H}")
def storage_path(spark, d):
    return _hashed(spark, d).select("file_id", F.concat_ws("/", F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.concat(F.lit("report_"), (F.col("file_id") % 7).cast("string")), F.concat("content_hash", F.lit(".pdf"))).alias("path"))


@query("verify_content_hash", f"SELECT file_id, content_hash = CASE WHEN file_id % 13 = 0 THEN upper(content_hash) ELSE content_hash END AS ok FROM {_H}")
def verify_content_hash(spark, d):
    expected = F.when(F.col("file_id") % 13 == 0, F.upper("content_hash")).otherwise(F.col("content_hash"))
    return _hashed(spark, d).select("file_id", (F.sha2("content", 256) == expected).alias("ok"))


_UID = "CASE file_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'a b/' || user_id ELSE repeat('x', 70) || user_id END"


@query("collection_name", f"SELECT file_id, CASE WHEN regexp_full_match('user_' || u, '[A-Za-z0-9][A-Za-z0-9_-]{{1,61}}[A-Za-z0-9]') THEN 'user_' || u ELSE 'user_' || substr(sha256(u), 1, 56) END AS collection FROM (SELECT file_id, {_UID} AS u FROM files)")
def q_collection_name(spark, d):
    u = F.col("user_id").cast("string")
    uid = F.when(F.col("file_id") % 3 == 0, u).when(F.col("file_id") % 3 == 1, F.concat(F.lit("a b/"), u)).otherwise(F.concat(F.repeat(F.lit("x"), 70), u))
    return files(spark, d).select("file_id", collection_name(uid).alias("collection"))


@query("storage_info", "SELECT user_id, count(*) AS files, round(sum(strlen(content)) / 1048576.0, 6) AS total_mb FROM files GROUP BY 1")
def storage_info(spark, d):
    return files(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(F.octet_length("content")) / 1048576, 6).alias("total_mb"))


_CREATED = "CASE WHEN event_id % 29 = 0 THEN 'unreadable' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@query("ttl_expire", f"SELECT event_id, coalesce(TRY_CAST({_CREATED} AS TIMESTAMP) < TIMESTAMP '{EVENTS_ASOF}' - INTERVAL 2 HOUR, true) AS expired FROM events")
def ttl_expire(spark, d, asof: str = EVENTS_ASOF, hours: int = 2):
    created = F.when(F.col("event_id") % 29 == 0, "unreadable").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    limit = F.lit(asof).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return table(spark, d, "events").select("event_id", F.coalesce(created.try_cast("timestamp_ntz") < limit, F.lit(True)).alias("expired"))


@query("classify_file_type", f"SELECT file_id, CASE WHEN e = 'pdf' AND file_id % 4 = 0 THEN 'unknown' WHEN e IN ('pdf', 'docx', 'doc', 'txt') THEN e ELSE 'unknown' END AS file_type FROM (SELECT file_id, {_EXT} AS e FROM files)")
def classify_file_type(spark, d):
    """A pdf whose content check fails (here every fourth) is unknown."""
    kind = file_type(F.col("name"))
    return files(spark, d).select("file_id", F.when((kind == "pdf") & (F.col("file_id") % 4 == 0), "unknown").otherwise(kind).alias("file_type"))


#: Of the first five pages, of five lines each.
_HEAD = "(SELECT *, array_to_string(string_split(content, chr(10))[:25], chr(10)) AS head, least(5, ceil(len(string_split(content, chr(10))) / 5))::BIGINT AS p FROM files)"
_WORDS = "len(list_filter(string_split_regex(head, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"
_CLASS = f"""(SELECT file_id, name, w, images, density, CASE WHEN w < 50 THEN CASE WHEN images > 0 THEN 'image_based' ELSE 'empty' END WHEN density < 0.005 AND images > p THEN 'image_based' ELSE 'text_based' END AS content_type
    FROM (SELECT file_id, name, p, {_WORDS} AS w, file_id % 8 AS images, least(1.0, (length(head) - (p - 1)) / (p * 1000.0)) AS density FROM {_HEAD}))"""


def classify_content(rows: DataFrame, pages: int = 5, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Adds words, density, content_type and confidence, by the first pages only; images counts pictures on these pages."""
    lines = F.split("content", "\n")
    n = F.least(F.lit(pages), F.ceil(F.size(lines) / lines_per_page))
    out = rows.withColumns({"__head": F.array_join(F.slice(lines, 1, pages * lines_per_page), "\n"), "__n": n})
    words = F.size(F.filter(F.split("__head", r"[ \t\n\r\f\x0B]+"), lambda x: x != ""))
    out = out.withColumn("words", words).withColumn("density", F.least(F.lit(1.0), (F.length("__head") - (F.col("__n") - 1)) / (F.col("__n") * 1000)))
    few, sparse = F.col("words") < 50, (F.col("density") < 0.005) & (F.col("images") > F.col("__n"))
    kind = F.when(few & (F.col("images") > 0), "image_based").when(few, "empty").when(sparse, "image_based").otherwise("text_based")
    sure = F.when(few & (F.col("images") > 0), 0.9).when(few, 0.8).when(sparse, 0.7).otherwise(0.9)
    return out.withColumn("content_type", kind).withColumn("confidence", sure).drop("__head", "__n")


def _classified(spark, d):
    return classify_content(files(spark, d).withColumn("images", F.col("file_id") % 8))


@query("classify_content", f"SELECT file_id, w AS words, content_type, CASE WHEN content_type = 'empty' THEN 0.8 WHEN content_type = 'image_based' AND w >= 50 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM {_CLASS}")
def q_classify_content(spark, d):
    return _classified(spark, d).select("file_id", F.col("words").cast("long").alias("words"), "content_type", "confidence")


@query("recommend_processor", f"SELECT file_id, CASE WHEN e IN ('docx', 'doc', 'txt') THEN 'pdf' WHEN e = 'pdf' AND content_type = 'text_based' THEN 'pdf' WHEN e = 'pdf' AND content_type = 'image_based' THEN 'ocr' ELSE 'unsupported' END AS processor FROM (SELECT *, {_EXT} AS e FROM {_CLASS})")
def recommend_processor(spark, d):
    e, kind = extension(F.col("name")), F.col("content_type")
    return _classified(spark, d).select("file_id", F.when(e.isin("docx", "doc", "txt"), "pdf").when((e == "pdf") & (kind == "text_based"), "pdf").when((e == "pdf") & (kind == "image_based"), "ocr").otherwise("unsupported").alias("processor"))


_BAD = f"({_EXT} IS NULL OR {_EXT} NOT IN ('pdf', 'docx', 'doc', 'txt'))"


@query("validate_document", f"SELECT file_id, concat_ws(',', CASE WHEN {_BAD} THEN 'extension' END, CASE WHEN strlen(content) > 524288000 THEN 'too large' END, CASE WHEN content = '' THEN 'empty' END) AS errors, CASE WHEN file_id % 150 > 100 THEN 'many pages' ELSE '' END AS warnings FROM files")
def validate_document(spark, d):
    e, n = extension(F.col("name")), F.octet_length("content")
    bad = e.isNull() | ~e.isin(*ALLOWED)
    return files(spark, d).select("file_id", messages((bad, "extension"), (n > 524288000, "too large"), (n == 0, "empty")).alias("errors"), messages((F.col("file_id") % 150 > 100, "many pages")).alias("warnings"))


@query("validate_ocr_document", "SELECT file_id, concat_ws(',', CASE WHEN strlen(content) > 62914560 THEN 'too large' END, CASE WHEN p > 30 THEN 'too many pages' END) AS errors, CASE WHEN p > 20 THEN 'slow' ELSE '' END AS warnings FROM (SELECT *, file_id % 40 AS p FROM files)")
def validate_ocr_document(spark, d):
    p = F.col("file_id") % 40
    return files(spark, d).select("file_id", messages((F.octet_length("content") > 62914560, "too large"), (p > 30, "too many pages")).alias("errors"), messages((p > 20, "slow")).alias("warnings"))


_ODD = "CASE file_id % 6 WHEN 0 THEN name WHEN 1 THEN 'up/load: ' || name WHEN 2 THEN ' ..' || name || '. ' WHEN 3 THEN '...' WHEN 4 THEN repeat('n', 300) || name ELSE '' END"


@query("sanitize_filename", rf"""SELECT file_id, CASE WHEN raw = '' THEN 'unnamed_file' WHEN b = '' THEN 'sanitized_file' WHEN length(b) > 255 THEN substr(b, 1, 255 - length(regexp_extract(b, '[^.](\.[^.]*)$', 1))) || regexp_extract(b, '[^.](\.[^.]*)$', 1) ELSE b END AS safe
    FROM (SELECT file_id, raw, regexp_replace(regexp_replace(string_split(raw, '/')[-1], '[<>:"|?*\\]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS b FROM (SELECT file_id, {_ODD} AS raw FROM files))""")
def q_sanitize_filename(spark, d):
    i, n = F.col("file_id") % 6, F.col("name")
    odd = F.when(i == 0, n).when(i == 1, F.concat(F.lit("up/load: "), n)).when(i == 2, F.concat(F.lit(" .."), n, F.lit(". "))).when(i == 3, "...").when(i == 4, F.concat(F.lit("n" * 300), n)).otherwise("")
    return files(spark, d).select("file_id", sanitize_filename(odd).alias("safe"))


@query("sniff_type", "SELECT page_id, CASE WHEN starts_with(h, '%PDF') THEN 'pdf' WHEN starts_with(h, '{\\rtf') THEN 'rtf' WHEN starts_with(lower(h), '<!doctype') OR starts_with(lower(h), '<html') THEN 'html' ELSE 'unknown' END AS kind FROM (SELECT page_id, substr(CASE WHEN page_id % 5 = 0 THEN '%PDF-1.7' || html ELSE html END, 1, 16) AS h FROM pages)")
def sniff_type(spark, d):
    html = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.col("html"))
    h = F.substring(html, 1, 16)
    kind = F.when(h.startswith("%PDF"), "pdf").when(h.startswith("{\\rtf"), "rtf").when(F.lower(h).startswith("<!doctype") | F.lower(h).startswith("<html"), "html").otherwise("unknown")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


@query("scan_active_content", "SELECT page_id, contains(lower(substr(html, 1, 1024)), 'mz') OR contains(lower(substr(html, 1, 1024)), '<script') AS executable, contains(lower(substr(html, 1, 4096)), '<object') OR contains(lower(substr(html, 1, 4096)), '<embed') OR contains(lower(substr(html, 1, 4096)), 'javascript:') AS embedded FROM pages")
def scan_active_content(spark, d):
    head, more = F.lower(F.substring("html", 1, 1024)), F.lower(F.substring("html", 1, 4096))
    return table(spark, d, "pages").select("page_id", (head.contains("mz") | head.contains("<script")).alias("executable"), (more.contains("<object") | more.contains("<embed") | more.contains("javascript:")).alias("embedded"))


@query("validate_upload", f"SELECT file_id, NOT {_BAD} AND content <> '' AND strlen(content) <= 52428800 AND NOT contains(content, chr(1)) AS valid, concat_ws(',', CASE WHEN {_BAD} THEN 'extension' END, CASE WHEN content = '' THEN 'empty' END, CASE WHEN strlen(content) > 52428800 THEN 'size' END, CASE WHEN contains(content, chr(1)) THEN 'binary' END) AS errors, content_hash FROM {_H}")
def validate_upload(spark, d):
    e, n = extension(F.col("name")), F.octet_length("content")
    errors = messages((e.isNull() | ~e.isin(*ALLOWED), "extension"), (n == 0, "empty"), (n > 52428800, "size"), (F.col("content").contains("\x01"), "binary"))
    return _hashed(spark, d).select("file_id", (errors == "").alias("valid"), errors.alias("errors"), "content_hash")


_MBS = "(file_id % 30) * 1048576 + 52429"


@query("validate_attachment", f"SELECT file_id, reason = '' AS ok, reason FROM (SELECT file_id, CASE WHEN {_BAD} THEN 'type not allowed' WHEN {_MBS} > 26214400 THEN 'too large: ' || printf('%.1f', ({_MBS}) / 1048576.0) || ' MB' ELSE '' END AS reason FROM files)")
def validate_attachment(spark, d):
    e, size = extension(F.col("name")), F.col("file_id") % 30 * 1048576 + 52429
    reason = F.when(e.isNull() | ~e.isin(*ALLOWED), "type not allowed").when(size > 26214400, F.format_string("too large: %.1f MB", size / 1048576)).otherwise("")
    return files(spark, d).select("file_id", (reason == "").alias("ok"), reason.alias("reason"))


@query("template_pagebreaks", """SELECT page_id, md5(regexp_replace(t, '(?i)<!--\\s*pagebreak\\s*-->', '<div class="page-break"></div>', 'g')) AS html_md5 FROM (SELECT page_id, replace(html, '<p', CASE WHEN page_id % 2 = 0 THEN '<!-- PageBreak --><p' ELSE '<!--pagebreak--><p' END) AS t FROM pages)""")
def template_pagebreaks(spark, d):
    mark = F.when(F.col("page_id") % 2 == 0, "<!-- PageBreak --><p").otherwise("<!--pagebreak--><p")
    out = F.regexp_replace(F.replace("html", F.lit("<p"), mark), r"(?i)<!--\s*pagebreak\s*-->", '<div class="page-break"></div>')
    return table(spark, d, "pages").select("page_id", F.md5(out).alias("html_md5"))


@query("dedup_by_hash", f"SELECT file_id, user_id, CASE WHEN status = 'failed' THEN 'failed' WHEN original_file_id IS NOT NULL THEN 'duplicate' ELSE 'ok' END AS status, original_file_id FROM {_DUP}")
def q_dedup_by_hash(spark, d):
    rows = dedup_by_hash(_hashed(spark, d))
    return rows.select("file_id", "user_id", F.when(F.col("status") == "failed", "failed").when(F.col("original_file_id").isNotNull(), "duplicate").otherwise("ok").alias("status"), "original_file_id")


@query("upload_summary", f"SELECT user_id, count(*) AS total, count(*) FILTER (status <> 'failed' AND original_file_id IS NULL) AS successful, count(*) FILTER (status = 'failed') AS failed, count(original_file_id) AS duplicates FROM {_DUP} GROUP BY 1")
def upload_summary(spark, d):
    rows = dedup_by_hash(_hashed(spark, d))
    failed = F.col("status") == "failed"
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed & F.col("original_file_id").isNull()).alias("successful"), F.count_if(failed).alias("failed"), F.count("original_file_id").alias("duplicates"))


@query("idempotent_ingest", "SELECT job_id, 'm' || (job_id % 9000) AS message_id, min(job_id) OVER (PARTITION BY job_id % 9000) AS first_job, job_id <> min(job_id) OVER (PARTITION BY job_id % 9000) AS duplicate FROM email_jobs")
def idempotent_ingest(spark, d):
    """A known message id gives the job that it made first. Minima are formed before the shuffle."""
    rows = email_jobs(spark, d).select("job_id", F.concat(F.lit("m"), (F.col("job_id") % 9000).cast("string")).alias("message_id"))
    first = rows.groupBy("message_id").agg(F.min("job_id").alias("first_job"))
    return rows.join(first, "message_id").withColumn("duplicate", F.col("job_id") != F.col("first_job"))
