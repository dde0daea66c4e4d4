"""Model answers: calls, parsing, quality and assembly."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.views import table

#: Phrases that tell an answer's quality, in the order in which they are tried.
NOT_FOUND = ("not found", "no information", "not available", "not mentioned")
PARTIAL = ("partially", "incomplete", "some information")
UNCERTAIN = ("unclear", "uncertain", "possibly", "might be")


def clean_json(text: Column) -> Column:
    """The text without a fence of three backticks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def parse_answer(text: Column, name: Column) -> Column:
    """The value under the name, else the first value, else `Not found`; what isn't JSON gives `JSON parsing error`."""
    values = F.from_json(clean_json(text), "map<string,string>", {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(clean_json(text)).isNotNull() & values.isNotNull()
    first = F.try_element_at(F.map_values(values), F.lit(1))
    return F.when(ok, F.coalesce(F.try_element_at(values, name), first, F.lit("Not found"))).otherwise("JSON parsing error")


def answer_quality(answer: Column) -> Column:
    low = F.lower(F.trim(answer))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    real = (F.length(low) > 3) & ~low.rlike(r"^(n/a|na|none)\b")
    return F.when(has(NOT_FOUND), "not_found").when(has(PARTIAL), "partial").when(has(UNCERTAIN), "uncertain").when(real, "found").otherwise("not_found")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")).cast("long")


def stub_model(prompt: str, schema: str) -> str:
    """A stand-in for a model: the first words of the prompt as JSON."""
    return json.dumps({json.loads(schema)["name"]: " ".join(prompt.split()[:5])})


def model_map(prompts: DataFrame, answer: Callable[[str, str], str] = stub_model) -> DataFrame:
    """id, response, error: answer called per prompt; an error gives an error row, never a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for prompt, schema in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    out.append(answer(prompt or "", schema))
                    errors.append(None)
                except Exception as e:  # a caller's function may fail in any way
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["id", "response", "error"])

    return prompts.select("id", "prompt", "schema").mapInArrow(run, "id long, response string, error string")


def _responses(spark, d):
    """id, name, response: conversations as model responses; some fenced, some broken, some under a wrong key."""
    c, t = table(spark, d, "conversations"), F.col("turn")
    i = F.col("conv_id") * 10 + t
    name = F.concat(F.lit("q"), (i % 7).cast("string"))
    key = F.when(i % 13 == 0, "other").otherwise(name)
    body = F.concat(F.lit('{"'), key, F.lit('": "'), F.regexp_replace("text", r'["\\\n\r\t]', " "), F.lit('"}'))
    text = F.when(i % 11 == 0, F.concat(F.lit("sorry: "), body)).when(i % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return c.select(i.alias("id"), name.alias("name"), text.alias("response"))


_RAW = r"""(SELECT id, name, CASE WHEN id % 11 = 0 THEN 'sorry: ' || body WHEN id % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS response, plain FROM (
    SELECT id, name, plain, '{"' || CASE WHEN id % 13 = 0 THEN 'other' ELSE name END || '": "' || plain || '"}' AS body FROM (SELECT conv_id * 10 + turn AS id, 'q' || ((conv_id * 10 + turn) % 7) AS name, regexp_replace(text, '["\\\n\r\t]', ' ', 'g') AS plain FROM conversations)))"""
_CLEAN = r"trim(regexp_replace(regexp_replace(trim(response), '^```(?:json)?\s*', ''), '\s*```$', ''))"
_ANSWER = f"(SELECT id, name, CASE WHEN id % 11 = 0 THEN 'JSON parsing error' ELSE plain END AS answer FROM {_RAW})"


@query("clean_json", f"SELECT id, {_CLEAN} AS response FROM {_RAW}")
def q_clean_json(spark, d):
    return _responses(spark, d).select("id", clean_json(F.col("response")).alias("response"))


@query("parse_answer", f"SELECT id, answer FROM {_ANSWER}")
def q_parse_answer(spark, d):
    return _responses(spark, d).select("id", parse_answer(F.col("response"), F.col("name")).alias("answer"))


def _in(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


_QUALITY = f"CASE WHEN {_in(NOT_FOUND)} THEN 'not_found' WHEN {_in(PARTIAL)} THEN 'partial' WHEN {_in(UNCERTAIN)} THEN 'uncertain' WHEN length(l) > 3 AND NOT regexp_matches(l, '^(n/a|na|none)\\b') THEN 'found' ELSE 'not_found' END"


@query("answer_quality", f"SELECT id, {_QUALITY} AS quality FROM (SELECT id, lower(trim(CASE id % 6 WHEN 0 THEN 'Not found in text' WHEN 1 THEN 'It is UNCLEAR' WHEN 2 THEN 'None' ELSE answer END)) AS l FROM {_ANSWER})")
def q_answer_quality(spark, d):
    i = F.col("id") % 6
    a = F.when(i == 0, "Not found in text").when(i == 1, "It is UNCLEAR").when(i == 2, "None").otherwise(parse_answer(F.col("response"), F.col("name")))
    return _responses(spark, d).select("id", answer_quality(a).alias("quality"))


@query("word_count", r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM documents")
def q_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", word_count(F.coalesce("text", F.lit(""))).alias("words"))


@query("batch_answers", f"SELECT q.conv_id, q.name, coalesce(a.answer, 'Not processed') AS answer FROM (SELECT conv_id, 'q' || n AS name FROM (SELECT DISTINCT conv_id FROM conversations), range(7) r(n)) q LEFT JOIN (SELECT id // 10 AS conv_id, name, min(answer) AS answer FROM {_ANSWER} GROUP BY 1, 2) a ON a.conv_id = q.conv_id AND a.name = q.name")
def batch_answers(spark, d):
    """Each expected question of a conversation with its answer, or `Not processed`."""
    names = F.array(*[F.lit(f"q{n}") for n in range(7)])
    asked = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(names).alias("name"))
    got = _responses(spark, d).select(F.floor(F.col("id") / 10).cast("long").alias("conv_id"), "name", parse_answer(F.col("response"), F.col("name")).alias("a")).groupBy("conv_id", "name").agg(F.min("a").alias("a"))
    return asked.join(got.hint("merge"), ["conv_id", "name"], "left").select("conv_id", "name", F.coalesce("a", F.lit("Not processed")).alias("answer"))


@query("quotable_values", """SELECT doc_id AS id, 'list' AS kind, line_no AS index, NULL AS field, line AS value FROM doc_lines WHERE trim(line) <> ''
    UNION ALL SELECT conv_id, 'table', turn, f, v FROM (SELECT conv_id, turn, unnest(['role', 'text']) AS f, unnest([role, text]) AS v FROM conversations) WHERE trim(v) <> ''""")
def quotable_values(spark, d):
    """Leaf values of list and table answers that are not blank, with their place: the item, or the row and its column."""
    lists = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    leaves = lists.select(F.col("doc_id").alias("id"), F.lit("list").alias("kind"), F.posexplode("l").alias("index", "value")).select("id", "kind", F.col("index").cast("long").alias("index"), F.lit(None).cast("string").alias("field"), "value")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("role", "text")])).alias("x")
    tables = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.lit("table").alias("kind"), F.col("turn").alias("index"), cells).select("id", "kind", "index", "x.*")
    return leaves.unionByName(tables).where(F.trim("value") != "")


@query("model_map")
def q_model_map(spark, d):
    schema = F.to_json(F.struct(F.concat(F.lit("q"), F.col("turn").cast("string")).alias("name")))
    return model_map(table(spark, d, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("text").alias("prompt"), schema.alias("schema")))


#: Columns of the table questions.
COLUMNS = ("name", "value")


def _by_type(string: str, items: str, rows: str) -> Column:
    return F.when(F.col("answer_type") == "string", string).when(F.col("answer_type") == "list", items).otherwise(rows)


def answer_format(columns: tuple[str, ...] = COLUMNS) -> Column:
    """How a question wants its answer, by answer_type."""
    return _by_type("Answer with plain text.", "Answer with a JSON array of strings.", f"Answer with a JSON array of objects with the keys {', '.join(columns)}.")


def schema_hint(placeholder: Column, columns: tuple[str, ...] = COLUMNS) -> Column:
    """What the JSON of an answer looks like."""
    row = ", ".join(f'"{c}": "..."' for c in columns)
    return F.concat(F.lit('{"'), placeholder, F.lit('": '), _by_type('"..."', '["...", "..."]', f"[{{{row}}}]"), F.lit("}"))


def response_schema(placeholder: Column, columns: tuple[str, ...] = COLUMNS) -> Column:
    """The JSON schema of an answer: a string, an array of strings, or an array of objects with all columns."""
    fields, names = ",".join(f'"{c}":{{"type":"string"}}' for c in columns), ",".join(f'"{c}"' for c in columns)
    kind = _by_type('{"type":"string"}', '{"type":"array","items":{"type":"string"}}', f'{{"type":"array","items":{{"type":"object","properties":{{{fields}}},"required":[{names}]}}}}')
    return F.concat(F.lit('{"type":"object","properties":{"'), placeholder, F.lit('":'), kind, F.lit('},"required":["'), placeholder, F.lit('"]}'))


def _questions(spark, d):
    i = F.col("item_id")
    kind = F.when(i % 3 == 0, "string").when(i % 3 == 1, "list").otherwise("table")
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("q"), i.cast("string")).alias("placeholder"), F.col("text").alias("question"), kind.alias("answer_type"))


@query("build_prompts", """SELECT item_id, concat_ws(chr(10), 'Question q' || item_id || ': ' || b.text, CASE item_id % 3 WHEN 0 THEN 'Answer with plain text.' WHEN 1 THEN 'Answer with a JSON array of strings.' ELSE 'Answer with a JSON array of objects with the keys name, value.' END,
    'Context: ' || coalesce(nullif(d.text, ''), 'no relevant context'), '{"q' || item_id || '": ' || CASE item_id % 3 WHEN 0 THEN '"..."' WHEN 1 THEN '["...", "..."]' ELSE '[{"name": "...", "value": "..."}]' END || '}') AS prompt FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id * 5""")
def build_prompts(spark, d):
    """One prompt a question: the question, the form of its answer, its context, and what the JSON looks like."""
    context = table(spark, d, "documents").where("doc_id % 5 = 0").select((F.col("doc_id") / 5).cast("long").alias("item_id"), "text")  # the document that a question is about
    rows = _questions(spark, d).join(context.hint("merge"), "item_id", "left")
    known = F.coalesce(F.nullif("text", F.lit("")), F.lit("no relevant context"))
    prompt = F.concat_ws("\n", F.concat(F.lit("Question "), "placeholder", F.lit(": "), "question"), answer_format(), F.concat(F.lit("Context: "), known), schema_hint(F.col("placeholder")))
    return rows.select("item_id", prompt.alias("prompt"))


@query("answer_schema", """SELECT item_id, '{"type":"object","properties":{"q' || item_id || '":' || CASE item_id % 3 WHEN 0 THEN '{"type":"string"}' WHEN 1 THEN '{"type":"array","items":{"type":"string"}}'
    ELSE '{"type":"array","items":{"type":"object","properties":{"name":{"type":"string"},"value":{"type":"string"}},"required":["name","value"]}}' END || '},"required":["q' || item_id || '"]}' AS schema FROM benchmark""")
def answer_schema(spark, d):
    return _questions(spark, d).select("item_id", response_schema(F.col("placeholder")).alias("schema"))


@query("udf_model")
def udf_model(spark, d):
    return model_map(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), F.lit("{}").alias("schema")), lambda p, s: p.upper())
