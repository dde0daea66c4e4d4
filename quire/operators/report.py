"""Report population: placeholders, rendering, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.sources.views import table

#: What leads a question, and small words that don't make a name.
LEADS = "what is|what are|who is|where is|when is|how much|how many|extract|provide|list|identify"
SMALL = "the|a|an|of|for|in|on|at|by|with|from|to"


def placeholders(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"\{\{([A-Za-z0-9_]+)\}\}"), F.lit(1)))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def render_string(answer: Column) -> Column:
    return F.replace(escape_html(F.coalesce(answer, F.lit(""))), F.lit("\n"), F.lit("<br>"))


def render_list(items: Column) -> Column:
    lis = F.transform(items, lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) < 1, "<li>No items found</li>").otherwise(F.array_join(lis, "\n    "))


def list_items(answer: Column) -> Column:
    """The items of a list answer that came as text: those of a JSON array, else the text as one item."""
    return F.coalesce(F.when(F.ltrim(answer).startswith("["), F.from_json(answer, "array<string>")), F.array(answer))


def render_table(rows: Column, keys: list[str]) -> Column:
    """rows: array of maps. Keys give the columns; a missing value is blank. Without rows there is one that says so."""
    head = "<thead>\n      <tr>\n        " + "".join(f"<th>{k}</th>" for k in keys) + "\n      </tr>\n    </thead>"
    cell = lambda r, k: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.try_element_at(r, F.lit(k)), F.lit(""))), F.lit("</td>"))
    body = F.transform(rows, lambda r: F.concat(F.lit("<tr>\n        "), *[cell(r, k) for k in keys], F.lit("\n      </tr>")))
    none = F.lit(f'<tr><td colspan="{len(keys)}">No data</td></tr>')
    return F.concat(F.lit(head + "\n    <tbody>\n      "), F.when(F.size(rows) > 0, F.array_join(body, "\n      ")).otherwise(none), F.lit("\n    </tbody>"))


def table_error(message: str) -> str:
    return f"<thead><tr><th>Error</th></tr></thead><tbody><tr><td>{message}</td></tr></tbody>"


def render_table_text(answer: Column, keys: list[str]) -> Column:
    """A table answer that came as text: a JSON list of objects as render_table, else the error's form. What isn't an object in the list is passed over."""
    if not keys:
        return F.lit(table_error("Table columns not defined"))
    listed, named = F.concat(F.lit("["), answer, F.lit("]")), F.concat(F.lit('{"a": '), answer, F.lit("}"))
    # Spark's parsers pass over what follows a value; within a list and an object that is an error.
    whole = F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull() & (F.size(F.from_json(listed, "array<string>")) == 1)
    kind = F.schema_of_variant(F.try_parse_json(answer))
    items = F.filter(F.from_json(answer, "array<string>"), lambda x: x.startswith("{"))
    rows = F.transform(items, lambda x: F.from_json(x, "map<string,string>"))
    return (
        F.when(~F.coalesce(whole, F.lit(False)), table_error("Failed to parse table data"))
        .when(~kind.startswith("ARRAY"), table_error("Invalid table data format"))
        .when(F.size(F.from_json(answer, "array<string>")) == 0, table_error("No table data found"))
        .otherwise(render_table(rows, keys))
    )


def placeholder_name(question: Column) -> Column:
    """A name in Pascal case from a question, 30 characters at most."""
    out = F.regexp_replace(question, rf"^(?i:{LEADS})\s+", "")
    out = F.regexp_replace(F.regexp_replace(out, rf"\b(?i:{SMALL})\b", " "), "[?!.,;:]", "")
    words = F.filter(F.split(out, r"\s+"), lambda w: F.length(w) > 2)
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")
    return F.substring(F.regexp_replace(name, "^[^a-zA-Z]", "Field"), 1, 30)


def unique_names(rows: DataFrame) -> DataFrame:
    """Numbers from 1 on repeated names of an agent, in order; the first keeps its name."""
    n = F.row_number().over(W.partitionBy("agent", "name").orderBy("item_id")) - 1
    return rows.withColumn("n", n).withColumn("unique_name", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("name", F.col("n").cast("string")))).drop("n")


def populate(template: Column, answers: Column) -> Column:
    """template with each {{name}} replaced, one after the other; answers: array of structs (name, html, is_string, n_quotes).

    A text answer with quotes has their running numbers after it, [1] [2]; other answers count theirs without showing them.
    """
    start = F.struct(template.alias("html"), F.lit(1).alias("next"))

    def step(s: Column, a: Column) -> Column:
        mark = F.concat(F.lit("{{"), a["name"], F.lit("}}"))
        there = F.contains(s["html"], mark)
        numbers = F.transform(F.sequence(s["next"], s["next"] + a["n_quotes"] - 1), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))
        refs = F.when(a["is_string"] & (a["n_quotes"] > 0) & (a["html"] != ""), F.concat(F.lit(" "), F.array_join(numbers, " "))).otherwise("")
        return F.struct(F.replace(s["html"], mark, F.concat(a["html"], refs)).alias("html"), (s["next"] + F.when(there, a["n_quotes"]).otherwise(0)).alias("next"))

    return F.aggregate(answers, start, step, lambda s: s["html"])


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_TEMPLATES = "(SELECT page_id, html || '{{q' || page_id % 5 || '}} and {{q' || page_id % 3 || '}} {{bad-name}}' AS html FROM pages)"


def _templates(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", F.concat("html", F.lit("{{q"), (i % 5).cast("string"), F.lit("}} and {{q"), (i % 3).cast("string"), F.lit("}} {{bad-name}}")).alias("html"))


@query("template_placeholders", f"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '\\{{\\{{([A-Za-z0-9_]+)\\}}\\}}', 1)) AS placeholder FROM {_TEMPLATES}")
def template_placeholders(spark, d):
    return _templates(spark, d).select("page_id", F.explode(placeholders(F.col("html"))).alias("placeholder"))


@query("template_coverage", f"SELECT coalesce(t.page_id, q.page_id) AS page_id, coalesce(t.placeholder, q.placeholder) AS placeholder, q.placeholder IS NULL AS no_question, t.placeholder IS NULL AS no_placeholder FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '\\{{\\{{([A-Za-z0-9_]+)\\}}\\}}', 1)) AS placeholder FROM {_TEMPLATES}) t FULL JOIN (SELECT page_id, 'q' || n AS placeholder FROM pages, range(3) r(n)) q ON t.page_id = q.page_id AND t.placeholder = q.placeholder")
def template_coverage(spark, d):
    t = _templates(spark, d).select("page_id", F.explode(placeholders(F.col("html"))).alias("placeholder"), F.lit(True).alias("t"))
    q = table(spark, d, "pages").select("page_id", F.explode(F.array(F.lit("q0"), F.lit("q1"), F.lit("q2"))).alias("placeholder"), F.lit(True).alias("q"))
    return t.join(q.hint("merge"), ["page_id", "placeholder"], "full").select("page_id", "placeholder", F.col("q").isNull().alias("no_question"), F.col("t").isNull().alias("no_placeholder"))


_NAME = rf"""(SELECT item_id, item_id % 4 AS agent, substr(regexp_replace(array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(q, '^(?i:{LEADS})\s+', ''), '\b(?i:{SMALL})\b', ' ', 'g'), '[?!.,;:]', '', 'g'), '\s+'), lambda w: length(w) > 2), lambda w: upper(w[1]) || lower(w[2:])), ''), '^[^a-zA-Z]', 'Field'), 1, 30) AS name
    FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'What is the ' ELSE '' END || CASE WHEN item_id % 5 = 0 THEN 'total amount of the contract?' ELSE regexp_replace(text, '[^ -~]', '', 'g') END AS q FROM benchmark))"""


def _names(spark, d):
    i = F.col("item_id")
    q = F.concat(F.when(i % 2 == 0, "What is the ").otherwise(""), F.when(i % 5 == 0, "total amount of the contract?").otherwise(F.regexp_replace("text", "[^ -~]", "")))
    return table(spark, d, "benchmark").select("item_id", (i % 4).alias("agent"), placeholder_name(q).alias("name"))


@query("placeholder_names", f"SELECT item_id, name FROM {_NAME}")
def placeholder_names(spark, d):
    return _names(spark, d).select("item_id", "name")


@query("placeholder_unique", f"SELECT item_id, CASE WHEN n = 0 THEN name ELSE name || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY agent, name ORDER BY item_id) - 1 AS n FROM {_NAME})")
def placeholder_unique(spark, d):
    return unique_names(_names(spark, d)).select("item_id", "unique_name")


@query("render_string", f"SELECT page_id, replace({_ESC.format('html')}, chr(10), '<br>') AS html FROM pages")
def q_render_string(spark, d):
    return table(spark, d, "pages").select("page_id", render_string(F.col("html")).alias("html"))


@query("render_list", f"SELECT doc_id, CASE WHEN len(l) = 0 THEN '<li>No items found</li>' ELSE array_to_string(list_transform(l, lambda x: '<li>' || {_ESC.format('x')} || '</li>'), chr(10) || '    ') END AS html FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN [] WHEN doc_id % 9 = 2 THEN ['answer: ' || coalesce(text, '')] ELSE string_split(coalesce(text, ''), chr(10)) END AS l FROM documents)")
def q_render_list(spark, d):
    """Lists: most as arrays, some as the JSON text of one, some as plain text, some empty."""
    i, text = F.col("doc_id") % 9, F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    items = F.when(i == 0, F.array().cast("array<string>")).when(i == 1, list_items(F.to_json(lines))).when(i == 2, list_items(F.concat(F.lit("answer: "), text))).otherwise(lines)
    return table(spark, d, "documents").select("doc_id", render_list(items).alias("html"))


_ERROR = "'<thead><tr><th>Error</th></tr></thead><tbody><tr><td>{}</td></tr></tbody>'"
_HEAD = "'<thead>' || chr(10) || '      <tr>' || chr(10) || '        <th>role</th><th>text</th>' || chr(10) || '      </tr>' || chr(10) || '    </thead>' || chr(10) || '    <tbody>' || chr(10) || '      ' || "
_ROW = f"'<tr>' || chr(10) || '        <td>' || role || '</td><td>' || {_ESC.format('text')} || '</td>' || chr(10) || '      </tr>'"


@query(
    "render_table",
    f"""SELECT conv_id, CASE conv_id % 8 WHEN 1 THEN {_ERROR.format('Failed to parse table data')} WHEN 2 THEN {_ERROR.format('Invalid table data format')} WHEN 3 THEN {_ERROR.format('No table data found')}
      WHEN 4 THEN {_HEAD} '<tr><td colspan="2">No data</td></tr>' || chr(10) || '    </tbody>'
      ELSE {_HEAD} string_agg({_ROW}, chr(10) || '      ' ORDER BY turn) || chr(10) || '    </tbody>' END AS html FROM conversations GROUP BY conv_id""",
)
def q_render_table(spark, d):
    """Turns of a conversation as a table answer in JSON; of eight conversations one is broken, one an object, one empty, and one a list of texts."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    whole = F.to_json(F.transform("r", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    kind = F.col("conv_id") % 8
    answer = F.when(kind == 1, F.concat(whole, F.lit(", and"))).when(kind == 2, '{"role": "user"}').when(kind == 3, "[]").when(kind == 4, '["user", 1]').otherwise(whole)
    return rows.select("conv_id", render_table_text(answer, ["role", "text"]).alias("html"))


_SAFE = f"replace({_ESC.format('text')}, chr(10), '<br>')"


@query("populate_template", f"""SELECT conv_id, 'A: ' || coalesce(a, '{{{{q0}}}}') || ' B: ' || coalesce(b, '{{{{q1}}}}') || ' A: ' || coalesce(a, '{{{{q0}}}}') || ' C: ' || coalesce(c, '{{{{q2}}}}') AS html FROM (SELECT conv_id,
    max({_SAFE} || CASE WHEN {_SAFE} <> '' AND conv_id % 3 > 0 THEN array_to_string(list_transform(range(1, 1 + conv_id % 3), lambda i: ' [' || i || ']'), '') ELSE '' END) FILTER (turn = 0) AS a, max('<li>' || {_ESC.format('text')} || '</li>') FILTER (turn = 1) AS b,
    max({_SAFE} || CASE WHEN {_SAFE} <> '' THEN ' [' || (1 + p0 * (conv_id % 3) + p1 * 2) || ']' ELSE '' END) FILTER (turn = 2) AS c
    FROM (SELECT conv_id, turn, replace(text, '{{{{', '') AS text, count(*) FILTER (turn = 0) OVER w AS p0, count(*) FILTER (turn = 1) OVER w AS p1 FROM conversations WINDOW w AS (PARTITION BY conv_id)) GROUP BY 1)""")
def populate_template(spark, d):
    """Turn 0 and 2 as texts with numbered quotes (conv_id % 3, and one), turn 1 as a list with two."""
    text, turn = F.replace("text", F.lit("{{"), F.lit("")), F.col("turn")
    html = F.when(turn == 1, render_list(F.array(text))).otherwise(render_string(text))
    quotes = F.when(turn == 0, F.col("conv_id") % 3).when(turn == 1, 2).otherwise(1).cast("int")
    answer = F.struct("turn", F.concat(F.lit("q"), turn.cast("string")).alias("name"), html.alias("html"), (turn != 1).alias("is_string"), quotes.alias("n_quotes"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(answer)).alias("a"))
    return rows.select("conv_id", populate(F.lit("A: {{q0}} B: {{q1}} A: {{q0}} C: {{q2}}"), F.col("a")).alias("html"))


@query("reference_section", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, coalesce(d.source, 'Unknown Document') AS document, 1 + turn % 4 AS page, substr(c.text, 1, 200) AS quote FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 13")
def reference_section(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("document"))
    rows = table(spark, d, "conversations").withColumn("doc_id", F.col("conv_id") * 13).join(docs, "doc_id", "left")
    return rows.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("n"), F.coalesce("document", F.lit("Unknown Document")).alias("document"), (1 + F.col("turn") % 4).alias("page"), F.substring("text", 1, 200).alias("quote"))


@query("report_name", "SELECT conv_id, turn, 'Agent ' || conv_id % 5 || ' - ' || CASE WHEN turn % 2 = 0 THEN CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END ELSE strftime(TIMESTAMP '2024-01-31 09:05:00' + to_days(CAST(conv_id % 300 AS INTEGER)), '%Y-%m-%d %H:%M') END AS name FROM conversations")
def report_name(spark, d):
    subject = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    at = F.date_format(F.date_add(F.lit("2024-01-31").cast("date"), (F.col("conv_id") % 300).cast("int")), "yyyy-MM-dd '09:05'")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Agent "), (F.col("conv_id") % 5).cast("string"), F.lit(" - "), F.when(F.col("turn") % 2 == 0, subject).otherwise(at)).alias("name"))


@query("report_answers", """SELECT q.conv_id, q.n AS question_no, coalesce(c.text, '[No answer generated]') AS answer, sum(CASE WHEN c.text IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY q.conv_id ORDER BY q.n)::BIGINT AS last_quote FROM (SELECT DISTINCT conv_id, n FROM conversations, range(8) r(n)) q LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.n""")
def report_answers(spark, d, questions: int = 8):
    """Every question once; quote numbers run over the whole report."""
    c = table(spark, d, "conversations")
    asked = c.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(questions - 1).cast("long"))).alias("question_no"))
    rows = asked.hint("merge").join(c.select("conv_id", F.col("turn").alias("question_no"), "text"), ["conv_id", "question_no"], "left")
    quotes = F.sum(F.col("text").isNotNull().cast("long")).over(W.partitionBy("conv_id").orderBy("question_no"))
    return rows.select("conv_id", "question_no", F.coalesce("text", F.lit("[No answer generated]")).alias("answer"), quotes.alias("last_quote"))
