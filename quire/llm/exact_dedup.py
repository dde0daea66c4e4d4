"""Operator 1: exact dedup with two Bloom passes, in DataFrame operations only.

Hashes are cut into slices by their leading bits, so that the filter of a slice takes max_filter_mb at most
whatever the number of rows. Pass one counts, for each row's two slots, how many rows set the slot (summed
within tasks first), and keeps the slots set twice or more as a bitmap in blocks of 32,768 bits. Pass two
broadcasts the blocks and tests each row's slots. Rows of which a slot was set once are surely unique and
pass straight through; of the others, only the hash and the id shuffle, never a text. Slices are done one after the
other, each written before the next one's filter is made.

Hashes are written sorted within each task, so a slice reads its own pages of the written files.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import scratch, sent, staged

BITS_PER_ROW = 16
BLOCK = 32_768  # bits of one bitmap of bitmap_construct_agg
HASH_BITS = 60


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _part(digest: Column, at: int) -> Column:
    """15 hexadecimal digits of a SHA-256 as a number."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _slots(n_bits: int) -> Column:
    return F.array(F.pmod("h", F.lit(n_bits)), F.pmod(_part(F.col("text_sha256"), 17), F.lit(n_bits)))


def is_set(bits: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def bloom(rows: DataFrame, n_bits: int, least: int) -> DataFrame:
    """Over rows (h, text_sha256): blocks of the bits set by `least` rows or more."""
    slots = rows.select(F.explode(_slots(n_bits)).alias("slot"))
    often = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    return staged(often.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(bits), "bloom")


def with_maybe(rows: DataFrame, blocks: DataFrame, n_bits: int) -> DataFrame:
    """Pass two: rows plus maybe, false where the hash surely occurs once."""
    out, maybe = rows.withColumn("slots", _slots(n_bits)), F.lit(True)
    for i in (0, 1):
        side = blocks.select(F.col("block").alias(f"block{i}"), F.col("bits").alias(f"bits{i}"))
        out = out.withColumn(f"block{i}", F.bitmap_bucket_number(F.col("slots")[i])).join(F.broadcast(side), f"block{i}", "left")
        maybe = maybe & is_set(F.col(f"bits{i}"), F.col("slots")[i])
    return out.withColumn("maybe", maybe).select(*rows.columns, "maybe")


def _both(docs: DataFrame, max_filter_mb: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_sha256) of the rows that surely occur once, and of the others (written)."""
    digest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("text_sha256"))
    keys = staged(digest.withColumn("h", _part(F.col("text_sha256"), 1)).sortWithinPartitions("h"), "hashes")
    n_rows = keys.count()
    most = max(BLOCK, int(max_filter_mb * 8e6) // BLOCK * BLOCK)
    n_slices = max(1, -(-n_rows * BITS_PER_ROW // most))
    n_bits = most if n_slices > 1 else max(BLOCK, math.ceil(n_rows * BITS_PER_ROW / BLOCK) * BLOCK)
    marked = []
    for i in range(n_slices):
        low, high = ((k << HASH_BITS) // n_slices for k in (i, i + 1))
        own = keys if n_slices == 1 else keys.where((F.col("h") >= low) & (F.col("h") < high))
        # Written before the next slice begins, so that one slice's filter is in memory at a time.
        marked.append(staged(with_maybe(own, bloom(own, n_bits, 2), n_bits).drop("h"), "slice"))
    marked = reduce(DataFrame.unionAll, marked)
    return marked.where(~F.col("maybe")).drop("maybe"), staged(marked.where("maybe").drop("maybe"), "maybe-repeated")


def _groups(more: DataFrame) -> DataFrame:
    """The row that stays and the size of each group; summed within tasks before it shuffles."""
    return staged(more.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")


def exact_dedup(docs: DataFrame, max_filter_mb: float = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts equal each other. Of equal texts the largest doc_id stays.
    Of rows with the same text and doc_id all count in group_size, and one of them stays. A null doc_id
    sorts below every number. No rows give no rows. Other columns of docs are not read, so their names don't
    matter. A text of any length is hashed whole and takes no more than its own memory.
    """
    once, more = _both(docs, max_filter_mb)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    once = once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    out = more.join(_groups(more).hint("merge"), "text_sha256").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # The rows that stay are one a group, unless a (text, doc_id) repeats: then one of its rows stays.
    same = out.where("kept").groupBy("text_sha256", "doc_id", "keep_id", "group_size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    same = same.withColumn("kept", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i == 1)))
    return once.unionByName(out.where(~F.col("kept")).select(*columns)).unionByName(same.select(*columns))


def kept_documents(docs: DataFrame, max_filter_mb: float = 64, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs that stay, with their own columns; columns named __id and __sha must not be among them.

    What goes is decided on hashes and ids. Up to broadcast_rows rows that go are named to all tasks, and no text
    shuffles. Beyond, a Bloom filter of the repeated hashes is broadcast (max_filter_mb at most; fuller where
    there are more hashes, which costs time alone), rows outside it pass, and the others are merged with those that go.
    """
    if {"__id", "__sha"} & set(docs.columns):
        raise ValueError("columns named __id or __sha clash with this operator's own")
    with scratch(docs.sparkSession) as made:
        _, more = _both(docs, max_filter_mb)
        groups = _groups(more).where("group_size > 1")
        # gone: rows of groups whose id isn't the one that stays; twice: ids that stay on several rows
        ids = more.join(groups.hint("merge"), "text_sha256")
        ids = ids.groupBy("text_sha256", "doc_id", "keep_id").agg(F.count(F.lit(1)).alias("n"))
        ids = staged(ids.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")) | (F.col("n") > 1)).select(F.col("text_sha256").alias("__sha"), F.col("doc_id").alias("__id"), (F.col("n") > 1).alias("twice"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays")), "not-plain")
        made.keep(ids)
    marked = docs.withColumn("__sha", text_digest()).withColumn("__id", F.col("doc_id").cast("long"))
    named = ids.select(F.col("__sha").alias("sha"), F.col("__id").alias("id"))
    same = (F.col("__sha") == F.col("sha")) & F.col("__id").eqNullSafe(F.col("id"))
    if named.count() <= broadcast_rows:
        out = marked.join(F.broadcast(named), same, "left_anti").select(*docs.columns)
    else:
        hashes = staged(named.select(F.col("sha").alias("text_sha256"), _part(F.col("sha"), 1).alias("h")).distinct(), "repeated-hashes")
        n_bits = max(BLOCK, min(hashes.count() * BITS_PER_ROW, int(max_filter_mb * 8e6)) // BLOCK * BLOCK)
        own = marked.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "__sha", "__id", F.col("__sha").alias("text_sha256"), _part(F.col("__sha"), 1).alias("h"))
        own = with_maybe(own, bloom(hashes, n_bits, 1), n_bits)
        out = own.where(~F.col("maybe")).unionByName(own.where("maybe").join(named.hint("merge"), same, "left_anti"))
        out = out.select(*[F.col("own")[c].alias(c) for c in docs.columns])
    again = staged(ids.where("stays and twice").select(F.col("__sha").alias("sha"), F.col("__id").alias("id")), "repeated-ids")
    if again.isEmpty():
        return out
    repeated = marked.join(sent(again, broadcast_rows), same, "left_semi")
    return out.unionByName(repeated.dropDuplicates(["__sha", "__id"]).select(*docs.columns))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
