"""Operator 4: mix sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each source's target is its share of all words, capped at three times the source's size. A document is
taken floor(ratio) times, and once more if its hash lies below the source's threshold. The threshold
comes from a histogram: words summed by source and hash bucket, the buckets that fit the budget whole,
and a finer histogram of the one boundary bucket, LEVELS times. Nothing is sorted; thresholds of
smaller budgets lie below those of larger ones, so mixes nest but for one document a source, which closes
the gap that the last whole document leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.shared import WORD, global_row_number, scratch, sent, staged

BROADCAST_ROWS = 100_000  # sources whose plan is sent to all tasks; with more, rows and plan are merged
BITS, LEVELS = 12, 4  # bits of the hash that one histogram looks at; histograms


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds target, by sharing the excess until none is above its cap.

    Weights repeat along the sources in code point order, null last. Sources without words get 0.
    """
    ranked = global_row_number(sizes, "source", "__rank", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", weight.alias("w")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most, left, level, n_capped = cap * F.col("source_size"), float(total), 0.0, -1
    while True:  # each turn adds the sources that the last level put above their cap
        above = most < level * F.col("w")
        row = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("w"))).alias("free")).first()
        if row["n"] == n_capped or not row["free"]:
            break
        n_capped, left = row["n"], total - (row["held"] or 0.0)
        level = left / row["free"]
    return ranked.select("source", "source_size", F.least(most.cast("double"), level * F.col("w")).alias("target"))


def _bucket(level: int):
    return F.shiftright(F.col("h"), 60 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _hash() -> Column:
    """Of doc_id; rows without one are told apart by their texts."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), key).bitwiseAND((1 << 60) - 1)


def _plan(rows: DataFrame, weights: tuple[int, ...], cap: float, broadcast_rows: int) -> DataFrame:
    """source, source_size, target, copies, below, also: a row a source. rows: source, size, h.

    A row is taken copies times, once more if its h is less than below or equals also.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = source_targets(sizes, weights, cap).withColumn("copies", F.least(F.floor(ratio + 1e-12), F.lit(int(cap))).cast("long"))
    # have: words taken below the boundary bucket; want: words of the once-more part; low: hash where the bucket begins.
    plan = plan.withColumn("want", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("have", F.lit(0).cast("long")).withColumn("low", F.lit(0).cast("long"))
    plan = staged(plan, "plan-0")
    few = plan.count() <= broadcast_rows
    side = lambda x: (F.broadcast(x) if few else x.hint("merge")).alias("p")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    inside = rows.select("source", "h", "size")
    for level in range(LEVELS):
        if level:
            width = 60 - BITS * level
            inside = rows.alias("r").join(side(plan), same("r", "p")).where(F.shiftright("h", width) == F.shiftright("low", width)).select("r.source", "h", "size")
        sums = inside.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("words"))
        order = W.partitionBy("source").orderBy("b")
        sums = sums.withColumn("upto", F.sum("words").over(order)).alias("s")
        cut = plan.alias("p").join(sums, same("p", "s"), "left").groupBy("p.source").agg(
            F.max(F.when(F.col("have") + F.col("upto") <= F.col("want"), F.col("b"))).alias("full"),
            F.max(F.when(F.col("have") + F.col("upto") <= F.col("want"), F.col("upto"))).alias("words"),
        )
        plan = plan.alias("p").join(cut.alias("c"), same("p", "c")).select(
            "p.source", "source_size", "target", "copies", "want",
            (F.col("have") + F.coalesce("words", F.lit(0))).alias("have"),
            (F.col("low") + F.shiftleft(F.coalesce(F.col("full") + 1, F.lit(0)).cast("long"), 60 - BITS * (level + 1))).alias("low"),
        )
        plan = staged(plan, f"plan-{level + 1}")
    # The last boundary bucket holds one document, or a few of one hash: take it if that comes nearer.
    width = 60 - BITS * LEVELS
    edge = rows.alias("r").join(side(plan), same("r", "p")).where(F.shiftright("h", width) == F.shiftright("low", width))
    edge = edge.groupBy("p.source").agg(F.sum("size").alias("words"))
    more = F.coalesce(F.col("words") <= 2 * (F.col("want") - F.col("have")), F.lit(False))
    plan = plan.alias("p").join(edge.alias("e"), same("p", "e"), "left").select(
        "p.source", "source_size", "target", "copies", F.when(more, F.col("low") + (1 << width)).otherwise(F.col("low")).alias("below"),
        (F.col("want") - F.col("have") - F.when(more, F.col("words")).otherwise(0)).alias("gap"),
    )
    plan = staged(plan, "thresholds")
    # One document above the threshold closes what is left of the gap, the one whose size comes nearest.
    off = F.abs(F.col("size") - F.col("gap"))
    rest = rows.alias("r").join(side(plan), same("r", "p")).where((F.col("h") >= F.col("below")) & (F.col("size") > 0) & (off < F.abs("gap")))
    nearest = rest.groupBy("p.source").agg(F.min_by("h", F.struct(off.alias("off"), "h")).alias("also"))
    return staged(plan.alias("p").join(nearest.alias("n"), same("p", "n"), "left").select("p.*", "also"), "plan")


def _copies(plan: str, h: Column, size: Column, cap: float) -> Column:
    once_more = (h < F.col(f"{plan}.below")) | F.coalesce(h == F.col(f"{plan}.also"), F.lit(False))
    return F.when(size > 0, F.least(F.col(f"{plan}.copies") + once_more.cast("long"), F.lit(int(cap)).cast("long"))).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies (how often it is taken) and source.

    Null texts and texts without words have size 0 and take 0 words. A null source is a source like others.
    Rows that repeat a doc_id share its hash and are taken alike; rows with a null doc_id are told apart by
    their texts. No rows give no rows. Reruns agree, since the hash depends on doc_id and text alone. Other
    columns of docs are not read. Texts of any length are counted whole. The plan of up to broadcast_rows
    sources goes to all tasks; with more, rows (without texts) and plan are merged by source.
    """
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"), _hash().alias("h")), "sizes")
    out = rows.alias("r").join(sent(_plan(rows, weights, cap, broadcast_rows), broadcast_rows).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    copies = _copies("p", F.col("h"), F.col("size"), cap)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "r.source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with their own columns, whatever their names.

    Hash and size are computed on docs again, so texts are filtered where they are read: nothing sorts or shuffles
    them unless there are more than broadcast_rows sources.
    """
    with scratch(docs.sparkSession) as made:
        plan = _plan(staged(docs.select("source", _size().alias("size"), _hash().alias("h")), "sizes"), weights, cap, broadcast_rows)
        made.keep(plan)
    plan = sent(plan, broadcast_rows).alias("p")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("source").alias("source"), _size().alias("size"), _hash().alias("h"))
    out = own.alias("r").join(plan, F.col("r.source").eqNullSafe(F.col("p.source")))
    times = _copies("p", F.col("h"), F.col("size"), cap).cast("int")
    out = out.where(times > 0).select("own", F.explode(F.array_repeat(F.lit(1), times)).alias("i"))
    return out.select(*[F.col("own")[c].alias(c) for c in docs.columns])
