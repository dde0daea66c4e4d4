"""Operator 2: n-gram Jaccard join by rare-first prefix filtering.

Texts with one set of shingles form a class, and one text stands for it. Shingles are ordered rare first,
by a count sketch of fixed size over all texts, then by hash. Sets that are similar enough share one of
their first |x| - ceil(t |x|) + 1 shingles; these prefixes are joined on the shingle.

A group of sets that share a prefix shingle isn't expanded into pairs at once. First each set is held only
against the group's most central one (that with the fewest rarer shingles before the common one). Groups
whose sets are then all in one component are done. What is left over are pairs of different components, and
all of those that pass the length and positional filters are verified too, so no link is lost. A pair is
verified once: suffix filter, then the exact intersection of both texts' sets.

That second join takes less than the prefix of the smaller set: at least 2t / (1 + t) of it must be common, so
the first common shingle is among its first |y| - ceil(2t |y| / (1 + t)) + 1. Pairs meet by shingle and
band of sizes, a band being as wide as the length filter. Sets of one template whose own shingles keep them
apart hold the template's outside that shorter prefix, so they don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bytetext import LOWER, U, mix64, prefix_hash, span_hash, texts, words
from quire.llm.components import components
from quire.llm.exact_dedup import BLOCK, is_set
from quire.llm.shared import BROADCAST_ROWS, handing_back, removed, scratch, sent, staged

SKETCH_BITS, CHUNK_BITS = 22, 16


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a text of fewer words has its whole sequence as one."""
    data = LOWER[data]
    starts, ends, at = words(data, off)
    h = span_hash(prefix_hash(data), starts, ends)
    rolled = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        rolled = mix64(rolled + h[j : j + len(rolled)] * U(2 * j + 3))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        else:
            one = np.full(1 if b > a else 0, U(b - a))
            for j in range(a, b):
                one = mix64(one + h[j : j + 1] * U(2 * (j - a) + 1))
            out.append(one)
    return out


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set: equal sets have equal numbers."""
    total = np.array([int(mix64(s * U(3)).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return mix64(total + np.fromiter(map(len, sets), np.uint64, len(sets))).view(np.int64)


def _packed(part: np.ndarray) -> bytes:
    """The counts of a chunk; where few are not 0, the places of those as 16 bits each and then their counts."""
    at = np.flatnonzero(part)
    if 6 * len(at) >= 4 * len(part):
        return part.astype("<u4").tobytes()
    return at.astype("<u2").tobytes() + part[at].astype("<u4").tobytes()


def _add_packed(raw: bytes | memoryview, sums: np.ndarray) -> None:
    if len(raw) == 4 * len(sums):
        sums += np.frombuffer(raw, "<u4")
    else:
        n = len(raw) // 6
        sums[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: per text its class (node) and set size; per task and chunk its counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, waiting, size_waiting = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def count() -> None:
            np.add.at(sketch, np.concatenate(waiting), np.uint32(1))
            waiting.clear()

        for batch in batches:
            for i, data, off in texts(batch.column(2)):
                sets = shingles(data, off, n)
                waiting.append((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int32))
                size_waiting += len(waiting[-1])
                if size_waiting > 1 << 18:
                    count()
                    size_waiting = 0
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                own = batch.slice(i, len(sets))
                yield _first(own.column(0), own.column(1), pa.array(size), pa.array(_names(sets)), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()))
        if waiting:
            count()
        step = 1 << CHUNK_BITS
        for c in range(len(sketch) // step):
            part = sketch[c * step : (c + 1) * step]
            if part.any():
                no = pa.nulls(1, pa.int64())
                yield _first(no, no, no, no, pa.array([c], pa.int32()), pa.array([_packed(part)]))

    def _first(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "hash", "n_shingles", "node", "chunk", "counts"])

    rows = docs.select("doc_id", "hash", "text")
    return staged(rows.mapInArrow(handing_back(run), "doc_id long, hash long, n_shingles long, node long, chunk int, counts binary"), "sets")


def _sketch(first: DataFrame) -> np.ndarray:
    """The summed counts: 2^SKETCH_BITS numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _add_packed(raw.as_py(), sums.setdefault(c, np.zeros(1 << CHUNK_BITS, np.uint64)))
        for c, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.minimum(total, U(0xFFFFFFFF)).astype("<u4").tobytes()])], names=["chunk", "counts"])

    rows = first.where("chunk is not null").select("chunk", "counts").repartition(1 << (SKETCH_BITS - CHUNK_BITS), "chunk")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows.mapInArrow(handing_back(run), "chunk int, counts binary").toLocalIterator():
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["counts"], "<u4")
    return out


def _prefixes(rows: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """token, node, size, pos of the prefix shingles of each text of rows (one a class)."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for _, data, off in texts(batch.column(0)):
                token, node, size, pos = [], [], [], []
                sets = shingles(data, off, n)
                for s, name in zip(sets, _names(sets).tolist(), strict=True):
                    if not len(s):
                        continue
                    rare = counts[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                    k = len(s) + percent * len(s) // -100 + 1
                    first = np.lexsort((s, rare))[:k]
                    token.append(s[first])
                    node.append(np.full(k, name))
                    size.append(np.full(k, len(s)))
                    pos.append(np.arange(k))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in token], node, size, pos)], names=["token", "node", "size", "pos"])

    return rows.select("text").mapInArrow(handing_back(run), "token long, node long, size long, pos long")


def _passes(percent: int, s1: str, p1: str, s2: str, p2: str) -> Column:
    """Length filter, and positional filter for the first common shingle, which stands at p1 and p2."""
    s1, p1, s2, p2 = map(F.col, (s1, p1, s2, p2))
    longest = F.least(s1 - p1, s2 - p2)
    return (100 * F.least(s1, s2) >= percent * F.greatest(s1, s2)) & (longest * (100 + percent) >= percent * (s1 + s2))


def suffix_filter(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """A lower bound of the number of shingles in one of two ascending sets only, by halving; stops above most."""
    apart = abs(len(x) - len(y))
    if depth == 0 or not len(x) or not len(y) or apart > most:
        return apart
    at = len(y) // 2
    cut = int(np.searchsorted(x, y[at]))
    low = suffix_filter(x[:cut], y[:at], most, depth - 1)
    return low + suffix_filter(x[cut:], y[at:], most - low, depth - 1) if low <= most else low


def _verified(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. bodies: node, text."""
    left = bodies.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = bodies.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = batch.slice(k, 256)
                xs, ys = ([s for _, data, off in texts(own.column(c)) for s in shingles(data, off, n)] for c in (2, 3))
                ok = []
                for x, y in zip(xs, ys, strict=True):
                    total = len(x) + len(y)
                    need = -(-percent * total // (100 + percent))
                    ok.append(suffix_filter(x, y, total - 2 * need) <= total - 2 * need and len(np.intersect1d(x, y, assume_unique=True)) >= need)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return staged(both.mapInArrow(handing_back(run), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, text_hash.

    Two texts link if 100 * |intersection| >= percent * |union| of their sets of n-word shingles (words in
    lower case A-Z); shorter texts have their whole sequence as one shingle. component_id is the least doc_id
    that links reach. Null texts and texts without words have no set and link with nothing, not even each
    other. Rows that repeat a doc_id are texts like others. A null doc_id is never a component_id unless no
    other reaches it. No rows give no rows. Whole texts are read; a text takes about 60 bytes of a task's memory
    for each of its own. Other columns of docs are not read. Up to broadcast_rows keys are sent to all tasks in
    joins that only filter; beyond, both sides are merged.
    """
    with scratch(docs.sparkSession) as made:
        named, least = _named(docs, n, percent, broadcast_rows)
        made.keep(named, least)
    out = named.where("label is not null").join(least.hint("merge"), "label").select("doc_id", "n_shingles", "component_id", F.col("hash").alias("text_hash"))
    return out.unionByName(named.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("hash").alias("text_hash")))


def _named(docs: DataFrame, n: int, percent: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, n_shingles, label) of each row, label null where it has no set; (label, component_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    first = _first_pass(rows, n)
    sets = first.where("chunk is null").drop("chunk", "counts")
    full = sets.where("n_shingles > 0")
    classes = full.groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "hash")).alias("r"), F.min("doc_id").alias("least"))
    classes = staged(classes.select("node", F.col("r.id").alias("id"), F.col("r.hash").alias("hash"), "least"), "classes")
    # Texts that don't stand for their class: told by (doc_id, hash of the text).
    others = full.join(classes.select("node", F.col("id").alias("__id"), F.col("hash").alias("__hash")).hint("merge"), "node")
    others = others.where((F.coalesce("doc_id", F.lit((1 << 63) - 1)) != F.col("__id")) | (F.col("hash") != F.col("__hash")))
    others = staged(others.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "hash").distinct(), "others")
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    standing = keyed.join(sent(others, broadcast_rows), ["id", "hash"], "left_anti")
    sketch = _sketch(first)
    labels = _labels(standing, sketch, n, percent, broadcast_rows)
    named = full.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    none = sets.where("n_shingles = 0").withColumn("label", F.lit(None).cast("long"))
    named = staged(named.unionByName(none).select("doc_id", "hash", "n_shingles", "label"), "named")
    return named, staged(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")


def _node_of(standing: DataFrame, n: int) -> DataFrame:
    """node, text of standing rows. Nothing in Python follows in the same stage, which would double its workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, off in texts(batch.column(0)):
                sets = shingles(data, off, n)
                yield pa.RecordBatch.from_arrays([pa.array(_names(sets)), batch.column(0).slice(i, len(sets))], names=["node", "text"])

    return standing.select("text").mapInArrow(handing_back(run), "node long, text string")


def _labels(standing: DataFrame, sketch: np.ndarray, n: int, percent: int, broadcast_rows: int) -> DataFrame:
    """node, label: the component of each node that has a link."""
    noded = _node_of(standing, n)
    prefixes = staged(_prefixes(standing, sketch, n, percent), "prefixes")
    shared = staged(_sharing(prefixes), "sharing")
    removed(standing.sparkSession, prefixes.folder)  # the largest of what is written here
    # The most central set of each group, by an aggregate: a common shingle is summed within tasks first.
    central = F.min(F.struct(F.col("pos").alias("pos2"), F.col("node").alias("node2"), F.col("size").alias("size2")))
    groups = staged(shared.groupBy("token").agg(central.alias("c")).select("token", "c.*"), "groups")
    live = staged(shared.join(sent(groups, broadcast_rows), "token"), "live")
    pair = [F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")]
    tried = live.where("node <> node2").where(_passes(percent, "size", "pos", "size2", "pos2")).select(*pair).distinct()
    tried = staged(tried, "pairs-1")
    links = _verified(tried, _bodies(noded, tried, broadcast_rows), n, percent)
    labels = components(links)
    # Groups that are not in one component yet: pairs of different components.
    own = live.select("token", "node", "size", "pos").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = staged(own, "labelled")
    mixed = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    own = staged(own.join(sent(staged(mixed, "mixed"), broadcast_rows), "token"), "open")
    rest = _open_pairs(own, percent)
    rest = staged(rest.join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs-2")
    more = _verified(rest, _bodies(noded, rest, broadcast_rows), n, percent)
    return labels if more.isEmpty() else components(links.unionByName(more))


def _sharing(prefixes: DataFrame, max_filter_mb: int = 64) -> DataFrame:
    """The rows of prefixes whose token stands in several.

    A bitmap of the shared tokens is broadcast first, of max_filter_mb at most, so that few of the others shuffle; a
    fuller one only lets more of them pass to the join that decides.
    """
    counts = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    twice = staged(counts.where("n > 1").select("token"), "shared-tokens")
    n_bits = max(BLOCK, min(16 * twice.count(), max_filter_mb * 8_000_000) // BLOCK * BLOCK)
    slot = F.pmod("token", F.lit(n_bits))
    bits = twice.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    maybe = prefixes.withColumn("block", F.bitmap_bucket_number(slot)).join(F.broadcast(staged(bits, "token-bits")), "block").where(is_set(F.col("bits"), slot))
    return maybe.select(*prefixes.columns).join(twice.hint("merge"), "token")


def _open_pairs(own: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different labels that share a shingle of own (token, node, size, pos, label) and pass the filters."""
    width = max(math.log(100 / percent), 1e-3) * 1.001  # a little more than the length filter allows
    own = own.withColumn("band", F.floor(F.log("size") / width))
    small = own.where(F.col("pos") <= F.col("size") + F.floor(-2 * percent * F.col("size") / (100 + percent)))
    small = small.select("token", "band", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "pos", "label")])
    large = own.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    order = (F.col("size2") < F.col("size")) | ((F.col("size2") == F.col("size")) & (F.col("node2") < F.col("node")))
    both = large.join(small.hint("merge"), ["token", "band"]).where(order & (F.col("label") != F.col("label2"))).where(_passes(percent, "size", "pos", "size2", "pos2"))
    return staged(both.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), "pairs-open")


def _bodies(noded: DataFrame, pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """node, text of the nodes in pairs; one a node."""
    nodes = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    return staged(noded.join(sent(nodes, broadcast_rows), "node", "left_semi"), "bodies")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay: of each component the one with the least doc_id. A repeated row stays as often as it is there.

    Columns of docs may have any names but __id and __hash. Rows that go are told by id and hash of the text, sent to
    all tasks up to broadcast_rows of them; beyond, texts shuffle to meet them.
    """
    if {"__id", "__hash"} & set(docs.columns):
        raise ValueError("columns named __id or __hash clash with this operator's own")
    with scratch(docs.sparkSession) as made:
        found = near_duplicates(docs, n, percent, broadcast_rows)
        gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
        gone = staged(gone, "gone")
        made.keep(gone)
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__hash", F.xxhash64("text"))
    return keyed.join(sent(gone, broadcast_rows), ["__id", "__hash"], "left_anti").select(*docs.columns)
