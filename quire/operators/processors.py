"""File processors as plug-ins: a Python table function, joined laterally to the files, that takes bytes and gives pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.files import extension
from quire.operators.text import _oracle_html, html_to_text
from quire.plans.registry import query
from quire.sources.views import files, table

LINES = 40  # of a page of plain text
NATIVE = ("html", "htm")  # by html_to_text, without Python

Processor = Callable[[bytes], Iterable[str]]


def text_pages(content: bytes) -> Iterator[str]:
    """Pages of LINES lines of UTF-8 text; other bytes are an error."""
    lines = content.decode("utf-8").split("\n")
    for i in range(0, len(lines), LINES):
        yield "\n".join(lines[i : i + LINES])


class Processors:
    """Processors by file extension. Names are lower-case, without the dot; one that is registered again gives way."""

    def __init__(self, own: dict[str, Processor] | None = None):
        self.own = dict(own or {})

    def register(self, name: str, processor: Processor) -> Processors:
        return Processors(self.own | {name.lower().lstrip("."): processor})

    def table_function(self):
        """(extension, content) to rows (page_no from 1, page, error). A processor that fails, or isn't there, gives one row with its error and page 0, after the pages it made."""
        own = self.own

        class ProcessFile:
            def eval(self, name: str, content: bytes):
                try:
                    if name not in own:
                        raise LookupError(f"no processor for {name}")
                    for i, page in enumerate(own[name](bytes(content or b"")), 1):
                        yield i, page, None
                except Exception as e:  # a plug-in may fail in any way
                    yield 0, None, f"{type(e).__name__}: {e}"

        return F.udtf(ProcessFile, returnType="page_no int, page string, error string")


PLAIN = Processors({"txt": text_pages, "doc": text_pages})


def process_files(rows: DataFrame, processors: Processors = PLAIN) -> DataFrame:
    """file_id, page_no, page, error: each file's pages by the processor of its name's extension.

    rows: file_id, name, content (binary). HTML goes through html_to_text in the JVM, as one page, unless a processor is registered for it. Null contents count as
    empty; files without an extension have no processor. A processor that gives no pages gives no rows.
    """
    rows = rows.select("file_id", F.coalesce(extension(F.col("name")), F.lit("")).alias("ext"), F.coalesce("content", F.lit(b"")).alias("content"))
    native = F.col("ext").isin([x for x in NATIVE if x not in processors.own])
    other = rows.where(~native)
    function = processors.table_function()
    pages = other.lateralJoin(function(F.col("ext").outer(), F.col("content").outer())).select("file_id", "page_no", "page", "error")
    html = rows.where(native).select("file_id", F.lit(1).alias("page_no"), html_to_text(F.col("content").cast("string")).alias("page"), F.lit(None).cast("string").alias("error"))
    return pages.unionByName(html)


def page_files(spark, d) -> DataFrame:
    """documents and pages as files with names: file_id, name, content."""
    docs = files(spark, d).select("file_id", "name", F.col("content").cast("binary").alias("content"))
    pages = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("file_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    return docs.unionByName(pages)


@query(
    "udtf_processor",
    f"""WITH f AS (SELECT file_id, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext, content FROM files),
    lines AS (SELECT file_id, string_split(content, chr(10)) AS l FROM f WHERE ext IN ('txt', 'doc'))
    SELECT file_id, p + 1 AS page_no, md5(array_to_string(l[p * {LINES} + 1 : (p + 1) * {LINES}], chr(10))) AS page, NULL AS error FROM (SELECT file_id, l, unnest(range(0, ceil(len(l) / {LINES})::INTEGER)) AS p FROM lines)
    UNION ALL SELECT file_id, 0, NULL, 'LookupError: no processor for ' || ext FROM f WHERE ext NOT IN ('txt', 'doc')
    UNION ALL SELECT -1 - page_id, 1, md5({_oracle_html()}), NULL FROM pages""",
)
def udtf_processor(spark, d):
    """Files and pages by their processors; texts as MD5."""
    return process_files(page_files(spark, d)).withColumn("page", F.md5("page")).withColumn("page_no", F.col("page_no").cast("long"))
