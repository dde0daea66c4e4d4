"""Template HTML from users: one scan over its tags, rebuilt from lists of what may stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.views import table

# Elements that may stay, attributes by element, and elements that go with their content.
TAGS = "a address article aside b blockquote br caption code col colgroup dd div dl dt em footer h1 h2 h3 h4 h5 h6 header hr i img li main mark nav ol p pre s section small span strong sub sup table tbody td tfoot th thead tr u ul".split()
ATTRIBUTES = {
    "*": "class dir id lang title",
    "img": "alt height loading width",
    "table": "border cellpadding cellspacing width",
    "th": "colspan rowspan scope width",
    "td": "colspan rowspan height width",
    "col": "span width",
    "colgroup": "span",
    "ol": "reversed start type",
    "li": "value",
}
DROPPED = "applet audio button canvas form head iframe math noscript object option script select style svg template textarea video".split()
RAW = "script style textarea iframe noscript".split()  # what they hold is no markup
VOID = "br col embed hr img input source track".split()
MAX_CHARS = 2_000_000

_ATTRIBUTE_RUN = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+"""
_RAW = rf"<({'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTE_RUN}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
_TOKEN = rf"(?is){_RAW}|<!--.*?(?:-->|\z)|<[!?][^>]*+(?:>|\z)|</?[A-Z][^\s/>]*+{_ATTRIBUTE_RUN}(?:>|\z)|[^<]++|<"
_ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+"""
_BREAK, _MARK = r"(?i)<!--\s*+pagebreak\s*+-->", "\ue000"
PAGE_BREAK = "<!-- pagebreak -->"


def _plain(text: Column) -> Column:
    """Text without a mark that could begin or end a tag."""
    for mark, name in (("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _attributes(tag: Column, name: Column) -> Column:
    """The allowed attributes of a start tag, quoted anew."""
    rest = F.regexp_replace(tag, r"(?s)^<[A-Za-z][^\s/>]*+|>$", "")
    both = F.arrays_zip(F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(2)).alias("v"))
    allowed = {tag: [*ATTRIBUTES["*"].split(), *names.split()] for tag, names in ATTRIBUTES.items() if tag != "*"}

    def kept(k: Column) -> Column:
        out = F.when(k.isin(ATTRIBUTES["*"].split()), True)
        for element, names in allowed.items():
            out = out.when((name == element) & k.isin(names), True)
        return out.otherwise(False)

    value = lambda v: F.replace(_plain(F.regexp_replace(v, r"""(?s)^["']|["']$""", "")), F.lit('"'), F.lit("&quot;"))
    pairs = F.filter(both, lambda a: kept(F.lower(a["k"])))
    return F.array_join(F.transform(pairs, lambda a: F.concat(F.lit(" "), F.lower(a["k"]), F.lit('="'), value(a["v"]), F.lit('"'))), "")


def sanitized(templates: DataFrame, html: str = "html") -> DataFrame:
    """templates with `html` made passive: elements and attributes from the lists, everything else gone or plain text.

    One scan cuts the text into tags, comments and text. A tag is read with all its attributes (quoted, bare, unquoted, after a slash) and
    written anew, so no attribute outside the lists can survive in any spelling, and marks left in text become character
    references. Dropped elements go with their content, nested ones too; one that isn't closed takes the rest along. Comments go but
    for page breaks. Links, images' sources and styles aren't on the lists. Null stays null, a text without safe content becomes
    empty. Rows that repeat are cleaned each for itself. A template's tags meet in one group.
    """
    n = "__row"
    rows = templates.withColumn(n, F.monotonically_increasing_id())
    text = F.regexp_replace(F.replace(F.col(html), F.lit(_MARK), F.lit("")), _BREAK, _MARK)
    tokens = rows.select(n, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("i", "t"))
    name = F.lower(F.regexp_extract("t", r"^</?([A-Za-z][^\s/>]*+)", 1))
    tokens = tokens.withColumns({"name": name, "closing": F.col("t").startswith("</")})
    opens = F.col("name").isin([x for x in DROPPED if x not in RAW]) & ~F.col("t").endswith("/>")  # raw elements are one token
    order = W.partitionBy(n).orderBy("i")
    tokens = tokens.withColumn("sum", F.sum(F.when(opens & F.col("closing"), -1).when(opens, 1).otherwise(0)).over(order))
    # An end tag without its start doesn't count: the depth is the running sum over its least value so far.
    tokens = tokens.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))
    tag = F.when(F.col("closing"), F.when(~F.col("name").isin(VOID), F.concat(F.lit("</"), "name", F.lit(">")))).otherwise(F.concat(F.lit("<"), "name", _attributes(F.col("t"), F.col("name")), F.lit(">")))
    out = F.when(F.col("depth") > 0, "").when(F.col("name").isin(TAGS) & F.col("t").endswith(">"), tag).when((F.col("name") != "") | F.col("t").rlike("^<[!?]"), "").otherwise(_plain(F.col("t")))
    whole = tokens.select(n, "i", F.coalesce(out, F.lit("")).alias("o")).groupBy(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x["o"]), "").alias("__html"))
    clean = F.trim(F.replace(F.coalesce("__html", F.lit("")), F.lit(_MARK), F.lit(PAGE_BREAK)))
    both = rows.join(whole.hint("merge"), n, "left")
    return both.withColumn(html, F.when(F.col(html).isNotNull(), clean)).drop(n, "__html")


@query("template_sanitize_html")
def template_sanitize_html(spark, d, most: int = MAX_CHARS):
    """Pages as templates: what is left, whether that makes a template, and its elements."""
    rows = sanitized(table(spark, d, "pages").select("page_id", "html", F.length("html").between(1, most).alias("fits")))
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))))
    return rows.select("page_id", "html", (F.col("fits") & (F.col("html") != "")).alias("valid"), tags.alias("tags"))
