"""Operator 3: personal data by bootstrapped contextual extraction, in DataFrame operations only.

Instances are words that hold a digit, and words one blank after a label (a word that ends in `=` or `:`).
An instance that overlaps a base span (email, ip, card, phone) is a seed; so is one with the form of a key:
20 or more letters, digits and `+/_=-`, among them 6 digits and 4 letters. Negatives are instances that overlap
a match that fails its check (a card's sum, a phone's length, an ip's parts), plain numbers of up to four
digits before the point, and words without digits that stand elsewhere in the corpus more often than not.

Seeds induce lexical patterns: the word on either side, the two words before, and a label within the word. A
pattern counts only if instances stand beside at least `contexts` of all its words' occurrences in the corpus, which
rules out words such as "the" that any number may follow. Scores go round that graph: an instance's is
that of its best pattern of high confidence, a seed's 1; a pattern's is the sum of its instances' scores over that sum
plus its negatives plus one. Unlabelled instances don't count against it, so that a few seeds are enough, but
those with a score must be `share` of all. Scores have three decimals and only rise, so the rounds end by themselves.
Instances beside high-confidence patterns, but for negatives, become spans of kind `id`.

Patterns start only where a run of their characters starts and repeat groups possessively, so that Java's
matcher neither recurses nor scans a run twice. Context words over 100 characters stand as their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.shared import sent, staged

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL, _LABEL, _BLANK = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", r"\x20\x09-\x0D"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": rf"(?<![^{_BLANK}])(?:[^{_BLANK}0-9]*+[0-9][^{_BLANK}]*+|(?<=[=:][{_BLANK}])[^{_BLANK}]++)",
}
#: Texts without these can't match.
_NEEDS = {"email": "@", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_MARK = r"\p{P}\p{S}&&[^@_$]"
_SMALL = r"^\$?[0-9]{1,4}(?:[.,][0-9]+)?$"
BROADCAST_ROWS = 100_000  # patterns, with their words, that are sent to all tasks


def _found(kind: str) -> Column:
    """Per match: (kind, place, characters since the match before, match, the last two words before it, the first after)."""
    p, text = PATTERNS[kind], F.col("text")
    gate = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike(rf"[0-9]|[=:][{_BLANK}]" if kind == "id" else "[0-9]")
    gaps, matches = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0))
    if kind == "id":
        last_two = lambda x: (lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))(F.filter(F.split(x, rf"[{_BLANK}]+"), lambda y: y != ""))
        near, far = lambda x: F.transform(last_two(x), _norm), lambda x: _norm(F.regexp_extract(x, rf"^[{_BLANK}]*+([^{_BLANK}]++)", 1))
    else:
        near, far = lambda x: F.lit(None).cast("array<string>"), lambda x: F.lit(None).cast("string")
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), matches.alias("match"), F.slice(gaps, 2, F.size(gaps)).alias("next")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(x["gap"]).cast("long").alias("gap"), x["match"].alias("match"), near(x["gap"]).alias("left"), far(x["next"]).alias("right")),
    )
    return F.when(gate, F.filter(rows, lambda x: x["match"].isNotNull()))


def _low(x: Column) -> Column:
    return F.translate(F.lower(x), "123456789", "0" * 9)


def _norm(word: Column) -> Column:
    """A context word: in lower case, every digit as 0."""
    low = _low(word)
    return F.when(F.length(low) > 100, F.sha2(low, 256)).otherwise(low)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def _holds() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(F.col("kind") == "card", n.between(12, 19) & _luhn(F.when(n <= 19, digits).otherwise("1")))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def matches(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, kind, failed, start, end, match, left, right; one row without a kind for a text that has none.

    kind `id` stands for instances; other kinds only for matches that hold, the others have none and failed. left: up to two words, right: one,
    for instances only; an instance beside another has that one as its neighbour.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<struct<kind:string,place:int,gap:bigint,match:string,left:array<string>,right:string>>")
    found = F.flatten(F.array(*[F.coalesce(_found(k), none) for k in KINDS]))
    out = staged(rows.select("row", "doc_id", F.explode_outer(found).alias("x")).select("row", "doc_id", "x.*"), "matches")
    order = W.partitionBy("row", "kind").orderBy("place")
    upto = F.sum(F.col("gap") + F.length("match")).over(order)
    before, after = (F.when(F.col("kind") == "id", _norm(f("match").over(order))) for f in (F.lag, F.lead))
    left = F.concat(F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>")), "left")
    out = out.withColumns({"end": upto, "left": left, "right": F.when(F.col("right") != "", F.col("right")).otherwise(after)})
    out = out.withColumn("start", F.col("end") - F.length("match"))
    holds = F.col("kind").isNull() | _holds()
    out = out.withColumns({"kind": F.when(holds, F.col("kind")), "failed": ~holds})
    return staged(out.select("row", "doc_id", "kind", "failed", "start", "end", "match", "left", "right"), "spans")


def _instances(spans: DataFrame) -> DataFrame:
    """row, start, end, value, word, base (overlaps a base span), seed, negative, patterns of all instances.

    word: the value in lower case where it has no digit.
    """
    order = W.partitionBy("row").orderBy("start", "end")

    def overlaps(of: Column) -> Column:
        before = F.max(F.when(of, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1)) > F.col("start")
        after = F.min(F.when(of, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing)) < F.col("end")
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    kind = F.coalesce("kind", F.lit(""))
    out = spans.where("kind is not null or failed").withColumns({"base": overlaps(~kind.isin("", "id")), "failed": overlaps(F.col("failed"))}).where(kind == "id")
    # A label within the word, and the word's own marks at its ends, don't belong to the identifier.
    label = F.lower(F.regexp_extract("match", r"^([\p{L}_]++[=:])", 1))
    head = F.length(label) + F.length(F.regexp_extract(F.substring(F.col("match"), F.length(label) + 1, F.length("match")), rf"^[{_MARK}&&[^+]]*+", 0))
    tail = F.length(F.regexp_extract("match", rf"(?<![{_MARK}])[{_MARK}]++$", 0))
    out = out.withColumns({"label": label, "head": F.least(head, F.length("match") - 1), "tail": tail})
    size = F.greatest(F.length("match") - F.col("head") - F.col("tail"), F.lit(1))
    out = out.withColumn("core", F.substring(F.col("match"), F.col("head") + 1, size))
    key = F.col("core").rlike(r"^[0-9A-Za-z+/_=-]{20,}$") & (F.regexp_count("core", F.lit("[0-9]")) >= 6) & (F.regexp_count("core", F.lit("[A-Za-z]")) >= 4)
    left = F.try_element_at("left", F.lit(-1))
    two = F.when(F.size("left") > 1, F.array_join(F.slice("left", -2, 2), " "))
    named = [("left", left), ("left2", two), ("right", F.col("right")), ("label", F.when(F.col("label") != "", _norm(F.col("label"))))]
    patterns = F.filter(F.array(*[F.concat(F.lit(f"{k} "), x) for k, x in named]), lambda x: x.isNotNull())
    start = F.col("start") + F.col("head")
    out = out.withColumns({"seed": F.col("base") | key, "low": F.lower("core")})
    negative = ~F.col("seed") & (F.col("failed") | F.col("core").rlike(_SMALL))
    word = F.when(~F.col("low").rlike("[0-9]") & (F.length("low") <= 100), F.col("low"))
    return out.select("row", start.alias("start"), (start + F.length("core")).alias("end"), F.xxhash64("low").alias("value"), word.alias("word"), "base", "seed", negative.alias("negative"), patterns.alias("patterns"))


def _occurrences(docs: DataFrame, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """before, word, occurrences of the terms in all texts; terms: word, and before: the word that must precede it, or null.

    Up to broadcast_rows of terms are sent to all tasks, which then count those only; beyond, all are counted.
    """
    words = F.array_remove(F.split(_low(F.col("text")), rf"[{_BLANK}]+"), "")
    both = F.arrays_zip(F.concat(F.array(F.lit("")), F.col("w")).alias("before"), F.col("w").alias("word"))
    tokens = docs.select(words.alias("w")).select(F.explode(both).alias("x")).select("x.before", "x.word").where("word is not null")
    singles = staged(terms.select("word").distinct(), "single-terms")
    pairs = staged(terms.where("before is not null").distinct(), "double-terms")
    if terms.count() <= broadcast_rows:
        kept = tokens.join(F.broadcast(singles), "word").join(F.broadcast(pairs.withColumn("pair", F.lit(True))), ["before", "word"], "left")
        counts = kept.groupBy(F.when(F.col("pair"), F.col("before")).alias("before"), "word").agg(F.count(F.lit(1)).alias("occurrences"))
    else:
        counts = tokens.groupBy("before", "word").agg(F.count(F.lit(1)).alias("occurrences")).join(singles.hint("merge"), "word")
    counts = staged(counts, "term-counts")
    single = counts.groupBy("word").agg(F.sum("occurrences").alias("occurrences")).select(F.lit(None).cast("string").alias("before"), "word", "occurrences")
    return staged(single.unionByName(counts.join(sent(pairs, broadcast_rows), ["before", "word"])), "occurrences")


def bootstrap(docs: DataFrame, instances: DataFrame, support: int = 3, confidence: float = 0.7, share: float = 0.1, contexts: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pattern, score) of high confidence, and (value) of the words that stand mostly elsewhere."""
    edges = instances.select("value", "word", "seed", "negative", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("negative").alias("negative"), F.first("word").alias("word"), F.count_if(~F.col("negative")).alias("n"))
    edges = staged(edges.withColumn("negative", F.col("negative") & ~F.col("seed")), "all-edges")
    # Only patterns that a few different instances share can ever matter.
    common = edges.groupBy("pattern").agg(F.count_if(~F.col("negative")).alias("values"), F.sum("n").alias("n")).where(F.col("values") >= support)
    parts = F.split("pattern", " ")
    named = {"word": F.when(parts[0] != "label", F.element_at(parts, -1)), "before": F.when(parts[0] == "left2", parts[1])}
    common = staged(common.withColumns(named), "common")
    edges = staged(edges.join(sent(common.select("pattern"), broadcast_rows), "pattern"), "edges")
    words = instances.where("word is not null").groupBy("word").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))
    words = staged(words.join(sent(staged(edges.select("value").distinct(), "edge-values")), "value", "left_semi"), "edge-words")
    terms = common.select("before", "word").where("word is not null").unionByName(words.select(F.lit(None).cast("string").alias("before"), "word"))
    counts = _occurrences(docs, staged(terms.distinct(), "terms"), broadcast_rows)
    seen = counts.select(F.col("before").alias("before2"), F.col("word").alias("word2"), "occurrences")
    seen = sent(seen, broadcast_rows)
    kept = common.join(seen, F.col("word").eqNullSafe(F.col("word2")) & F.col("before").eqNullSafe(F.col("before2")), "left")
    kept = staged(kept.where(F.col("occurrences").isNull() | (F.col("n") >= contexts * F.col("occurrences"))).select("pattern"), "kept-patterns")
    elsewhere = words.join(seen, (F.col("word") == F.col("word2")) & F.col("before2").isNull()).where(F.col("occurrences") > 2 * F.col("n"))
    elsewhere = staged(elsewhere.select("value"), "elsewhere")
    edges = edges.join(sent(kept, broadcast_rows), "pattern").join(sent(elsewhere.withColumn("out", F.lit(True))), "value", "left")
    edges = staged(edges.withColumn("negative", ~F.col("seed") & (F.col("negative") | F.col("out").isNotNull())).select("pattern", "value", "seed", "negative"), "kept-edges")
    known, last, i = edges.withColumn("s", F.col("seed").cast("double")), None, 0
    while True:
        sums = known.groupBy("pattern").agg(F.sum("s").alias("s"), F.count_if("negative").alias("bad"), F.count_if(F.col("s") >= confidence).alias("good"), F.count(F.lit(1)).alias("all"))
        score = F.floor(F.round(1000 * F.col("s") / (F.col("s") + F.col("bad") + 1), 6)) / 1000
        good = sums.where((F.col("good") >= support) & (F.col("good") >= share * F.col("all"))).select("pattern", score.alias("score")).where(F.col("score") >= confidence)
        good = staged(good, f"patterns-{i}")
        now = tuple(good.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "score").cast("decimal(20,0)"))).first())
        if now == last:
            return good, elsewhere
        last, i = now, i + 1
        values = edges.where("not negative").join(sent(good, broadcast_rows), "pattern").groupBy("value").agg(F.max("score").alias("score"))
        values = staged(values, f"instances-{i}")
        risen = F.when(F.col("negative"), 0.0).otherwise(F.greatest(F.col("seed").cast("double"), F.coalesce("score", F.lit(0.0))))
        known = edges.join(sent(values), "value", "left").withColumn("s", risen)


def personal_data(docs: DataFrame, support: int = 3, confidence: float = 0.7, share: float = 0.1, contexts: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans.

    spans: kind:start:end in code points, by start and then kind, comma-joined; counts of the base kinds
    are of base spans, n_id of those that patterns add. Null and empty texts have none, and the hash of an
    empty string. Rows that repeat a doc_id are searched each for itself. No rows give no rows. Whole texts of any
    length are searched; a text's matches and words meet in one row, some 200 bytes of a task's memory for each of them.
    Other columns of docs are not read.
    """
    spans = matches(docs)
    instances = staged(_instances(spans), "instances")
    good, elsewhere = bootstrap(docs, instances, support, confidence, share, contexts, broadcast_rows)
    unseen = instances.where(~F.col("base") & ~F.col("negative")).join(sent(elsewhere), "value", "left_anti").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    added = unseen.join(sent(good, broadcast_rows), "pattern").select("row", F.lit("id").alias("kind"), "start", "end").distinct()
    rows = spans.select("row", "doc_id", F.when(F.col("kind") != "id", F.col("kind")).alias("kind"), "start", "end").unionByName(added.withColumn("doc_id", F.lit(None).cast("long")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "end", F.concat_ws(":", "kind", "start", "end").alias("span")))
    out = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(one)).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    join = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    base = F.filter("all", lambda x: x["rank"] < len(KINDS))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(join(base), 256).alias("base_sha256"), join(F.col("all")).alias("spans"))
