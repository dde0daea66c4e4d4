"""Operator 11: hard negatives over Hilbert-ordered blocks with zone maps.

Rows are sorted by label and by their place on a Hilbert curve through the dimensions of most variance, and written as
blocks: a Parquet row for each `block_rows` rows, with their vectors as one matrix, and a zone map, the least and
the largest entry of each dimension and of the labels. For an anchor a, interval arithmetic bounds the inner product with any row of a
block: the sum over dimensions of max(a*low, a*high) from above, of min(...) from below. Searches go in turns:

1. each block's anchors against the block itself give a first fifth-best positive, a lower bound;
2. zone maps choose the blocks that hold the label and can reach that bound; these are read: the exact positives;
3. for each positive's score window, the `lead` most promising blocks that hold other labels are read: a first third-best;
4. zone maps choose the blocks whose bounds meet a window and reach its third-best; these are read: the exact negatives.

Anchors travel in batches (a block's), zone maps in pages of about `page_blocks`; each batch meets each page of zone maps once,
and a block's matrix goes to its own batches only. Scores are whole numbers: double products where they are below 2^53,
else Python's integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.llm.shared import handing_back, n_parts, scratch, staged
from quire.llm.vectors import by_dimension, finite

LOW, HIGH = -(1 << 63), (1 << 63) - 1
NO_ID = HIGH  # sorts behind every number
HILBERT_DIMS, HILBERT_BITS = 9, 7
BLOCK = "block bigint, n int, least array<double>, most array<double>, label_least bigint, label_most bigint, ids array<bigint>, labels array<bigint>, matrix binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates of `bits` bits, a row each (Skilling's transform). bits * dimensions is at most 63."""
    x = cells.astype(np.int64).copy()
    n, k = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(k):
            hit = (x[:, i] & q) != 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(hit, p, 0) ^ swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, k):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, k - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    place = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(k):
            place = (place << 1) | ((x[:, i] >> bit) & 1)
    return place


def _packed(m: np.ndarray) -> bytes:
    """16-bit where entries fit, else doubles; the first byte tells which."""
    small = m.size == 0 or np.abs(m).max() < 1 << 15
    return (b"s" + m.astype("<i2").tobytes()) if small else (b"d" + m.astype("<f8").tobytes())


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"s" else "<f8", offset=1).reshape(n, -1)


def _largest(m: np.ndarray) -> float:
    return float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows, int64; beyond 64 bits they stay at its ends."""
    if a.shape[1] * _largest(a) * _largest(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in m.tolist()], dtype=object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, LOW, HIGH).astype(np.int64)


def bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of the rows of a with anything between least and most, a row a block; rounding errors are allowed for."""
    plus, minus = np.maximum(a, 0.0), np.minimum(a, 0.0)
    upper, lower = plus @ most.T + minus @ least.T, plus @ least.T + minus @ most.T
    slack = 1e-12 * a.shape[1] * (np.abs(a) @ np.maximum(np.abs(least), np.abs(most)).T)
    return lower - slack, upper + slack


def windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score n with 50 * score <= 100 * n <= 95 * score."""
    values = [int(s) for s in scores]
    return np.array([-((-s) // 2) for s in values], np.int64), np.array([19 * s // 20 for s in values], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, then id."""
    keep = np.arange(len(scores))
    if len(scores) > 4 * k:  # all that are as good as the k-th
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return keep[np.lexsort((ids[keep], ~scores[keep]))[:k]]  # ~ turns the order of whole numbers around without overflow


def _ids(values: pa.Array) -> np.ndarray:
    return np.asarray(values.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)


def sort_keys(rows: DataFrame, d: int, dims: list[int], low: list[float], width: list[float]) -> DataFrame:
    """vec_id, label, place, vector of rows (vec_id, label, embedding): entries are multiplied by 256 and cut to whole numbers."""
    low_, width_ = np.array(low), np.array(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            q = np.floor(np.clip(x * 256.0, -1e300, 1e300))
            cells = np.clip((x[:, dims] - low_) / width_ * (1 << HILBERT_BITS), 0, (1 << HILBERT_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(cells, HILBERT_BITS)), pa.array([_packed(r) for r in q], pa.binary())], ["vec_id", "label", "place", "vector"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(handing_back(run), "vec_id bigint, label bigint, place bigint, vector binary")


def blocks(keyed: DataFrame, block_rows: int) -> DataFrame:
    """One row a block, of consecutive rows in the order of label and place."""

    def pack(number: int, ids: list, labels: list, vectors: list) -> tuple:
        m = np.vstack([_matrix(v, 1) for v in vectors]).astype(np.float64)
        return number, len(ids), m.min(0), m.max(0), min(labels), max(labels), ids, labels, _packed(m)

    schema = T.StructType.fromDDL(BLOCK)
    names = schema.names
    types = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list] = ([], [], [])

        def full() -> pa.RecordBatch:
            row = pack(number, *held)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                for part, v in zip(held, row, strict=True):
                    part.append(v)
                if len(held[0]) == block_rows:
                    yield full()
                    number += 1
                    for part in held:
                        part.clear()
        if held[0]:
            yield full()

    order = ["label", "place", "vec_id", "vector"]
    ranged = keyed.repartitionByRange(n_parts(keyed.sparkSession), *order[:3]).sortWithinPartitions(*order)
    return ranged.mapInArrow(handing_back(run), schema)


def batches_of(block: DataFrame, every: int, k: int) -> DataFrame:
    """The anchors of each block, as a batch with the block's number: where they stand in it, and the k-th best score of a positive within it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids = np.array([NO_ID if v is None else v for v in row["ids"]], np.int64)
                known = np.array([v is not None for v in row["ids"]])
                at = np.flatnonzero(known & (ids % every == 0))
                if not len(at):
                    continue
                m, labels = _matrix(row["matrix"], row["n"]), np.array(row["labels"], np.int64)
                scores, first = products(m[at], m), []
                for i, a in enumerate(at):
                    same = labels == labels[a]
                    same[a] = False
                    own = np.sort(scores[i][same])
                    first.append(int(own[-k]) if len(own) >= k else LOW)
                columns = [[row["block"]], [len(at)], [at], [ids[at]], [labels[at]], [first], [_packed(m[at].astype(np.float64))]]
                types = [pa.int64(), pa.int32(), *[pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())], pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["batch", "n_anchors", "at", "anchor_ids", "anchor_labels", "reach", "anchors"])

    schema = "batch bigint, n_anchors int, at array<int>, anchor_ids array<bigint>, anchor_labels array<bigint>, reach array<bigint>, anchors binary"
    return block.select("block", "n", "ids", "labels", "matrix").mapInArrow(handing_back(run), schema)


def zone_pages(block: DataFrame, page_blocks: int) -> tuple[DataFrame, int]:
    """(page, zones) with about page_blocks zone maps a row, and the number of pages."""
    n = max(1, -(-block.select("block").count() // page_blocks))
    zone = F.struct("block", "least", "most", "label_least", "label_most")
    return staged(block.groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).alias("page")).agg(F.collect_list(zone).alias("zones")), "zones"), n


def _zones(batch: pa.RecordBatch, column: str, i: int) -> tuple[np.ndarray, ...]:
    z = batch.column(column)[i].values
    k = len(z)
    least, most = (z.field(f).flatten().to_numpy(zero_copy_only=False).reshape(k, -1) for f in ("least", "most"))
    return z.field("block").to_numpy(zero_copy_only=False), least, most, *(z.field(f).to_numpy(zero_copy_only=False) for f in ("label_least", "label_most"))


def _lists(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in names]


PAIR = "batch bigint, block bigint, which array<int>"


def _pairs(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    batch, block, which = ([x[i] for x in found] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array(block, pa.int64()), pa.array(which, pa.list_(pa.int32()))], ["batch", "block", "which"])


def _meet(batches: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """Every batch with every page of zone maps."""
    side = batches.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_pages - 1).cast("bigint"))))
    return side.join(pages.hint("merge"), "page")


def positive_pairs(batches: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """Blocks that may hold a positive better than what an anchor's own block has: batch, block, which (anchors of the batch)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for i in range(part.num_rows):
                labels, reach = _lists(part, i, "anchor_labels", "reach")
                a = _matrix(part.column("anchors")[i].as_py(), len(labels)).astype(np.float64)
                block, least, most, first, last = _zones(part, "zones", i)
                _, upper = bounds(a, least, most)
                hit = (upper >= reach[:, None]) & (first[None, :] <= labels[:, None]) & (labels[:, None] <= last[None, :])
                batch = part.column("batch")[i].as_py()
                found += [(batch, int(block[j]), np.flatnonzero(hit[:, j])) for j in np.flatnonzero(hit.any(0))]
            yield _pairs(found)

    kept = batches.select("batch", "anchor_labels", "reach", "anchors")
    return _meet(kept, pages, n_pages).select("batch", "anchor_labels", "reach", "anchors", "zones").mapInArrow(handing_back(run), PAIR)


def negative_bounds(batches: DataFrame, pages: DataFrame, n_pages: int, lead: int) -> DataFrame:
    """batch, anchor, block, upper: of each page the `lead` blocks of largest upper bound that hold another label and meet one of the anchor's windows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], []]
            for i in range(part.num_rows):
                labels, which, low, high = _lists(part, i, "anchor_labels", "which", "low", "high")
                a = _matrix(part.column("anchors")[i].as_py(), len(labels)).astype(np.float64)
                block, least, most, first, last = _zones(part, "zones", i)
                lower, upper = bounds(a, least, most)
                for x in np.unique(which):
                    mine = which == x
                    meets = (upper[x][None, :] >= low[mine][:, None]) & (lower[x][None, :] <= high[mine][:, None])
                    at = np.flatnonzero(meets.any(0) & ~((first == labels[x]) & (last == labels[x])))
                    at = at[np.argsort(-upper[x][at], kind="stable")[:lead]]
                    for c, v in zip(out, ([part.column("batch")[i].as_py()] * len(at), [x] * len(at), block[at], upper[x][at]), strict=True):
                        c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["batch", "anchor", "block", "upper"])

    kept = ["batch", "anchor_labels", "which", "low", "high", "anchors"]
    return _meet(batches.select(*kept), pages, n_pages).select(*kept, "zones").mapInArrow(handing_back(run), "batch bigint, anchor int, block bigint, upper double")


def negative_pairs(batches: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """Blocks whose bounds meet a window of an anchor and reach what is known of it (`low`): batch, block, which."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for i in range(part.num_rows):
                labels, which, low, high = _lists(part, i, "anchor_labels", "which", "low", "high")
                a = _matrix(part.column("anchors")[i].as_py(), len(labels)).astype(np.float64)
                block, least, most, first, last = _zones(part, "zones", i)
                lower, upper = bounds(a, least, most)
                hit = np.zeros(upper.shape, bool)
                meets = (upper[which] >= low[:, None]) & (lower[which] <= high[:, None])
                np.logical_or.at(hit, which, meets)
                hit &= ~((first[None, :] == labels[:, None]) & (last[None, :] == labels[:, None]))
                batch = part.column("batch")[i].as_py()
                found += [(batch, int(block[j]), np.flatnonzero(hit[:, j])) for j in np.flatnonzero(hit.any(0))]
            yield _pairs(found)

    kept = ["batch", "anchor_labels", "which", "low", "high", "anchors"]
    return _meet(batches.select(*kept), pages, n_pages).select(*kept, "zones").mapInArrow(handing_back(run), PAIR)


HIT = "batch bigint, anchor int, number int, score bigint, id bigint"


def _read(pairs: DataFrame, batches: DataFrame, block: DataFrame, search: Callable) -> DataFrame:
    """search(anchors, block's rows) over all pairs. A block's matrix meets its pairs one after the other."""
    names = [c for c in batches.columns if c != "batch"]
    side = pairs.withColumnRenamed("which", "asked").join(batches.hint("merge"), "batch")
    both = side.join(block.select("block", "n", "ids", "labels", "matrix").hint("merge"), "block").select("batch", "block", "asked", *names, "n", "ids", "labels", "matrix")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], [], []]
            for i in range(part.num_rows):
                n = part.column("n")[i].as_py()
                m = _matrix(part.column("matrix")[i].as_py(), n)
                ids, labels = _ids(part.column("ids")[i].values), _lists(part, i, "labels")[0]
                batch, asked = part.column("batch")[i].as_py(), _lists(part, i, "asked")[0]
                anchor_labels = _lists(part, i, "anchor_labels")[0]
                a = _matrix(part.column("anchors")[i].as_py(), len(anchor_labels))
                scores = products(a[asked], m)
                for x, row in zip(asked, scores, strict=True):
                    for number, score, at in search(part, i, batch == part.column("block")[i].as_py(), x, anchor_labels[x], row, ids, labels):
                        for c, v in zip(out, ([batch] * len(at), [x] * len(at), [number] * len(at), score, ids[at]), strict=True):
                            c.extend(v)
            hit_ids = pa.array([None if v == NO_ID else v for v in out[4]], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out[:4], (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], hit_ids], ["batch", "anchor", "number", "score", "id"])

    return both.mapInArrow(handing_back(run), HIT)


def read_positives(pairs: DataFrame, batches: DataFrame, block: DataFrame, k: int) -> DataFrame:
    def search(part, i, own, x, label, row, ids, labels):
        same = labels == label
        if own:
            same[_lists(part, i, "at")[0][x]] = False
        at = np.flatnonzero(same & (row >= _lists(part, i, "reach")[0][x]))
        at = at[_best(row[at], ids[at], k)]
        yield 0, row[at], at

    return _first(_read(pairs, batches.select("batch", "anchor_labels", "at", "reach", "anchors"), block, search), k)


def read_negatives(pairs: DataFrame, batches: DataFrame, block: DataFrame, k: int) -> DataFrame:
    def search(part, i, own, x, label, row, ids, labels):
        which, number, low, high = _lists(part, i, "which", "number", "low", "high")
        mine = np.flatnonzero(which == x)
        other = np.flatnonzero((labels != label) & (row >= low[mine].min()) & (row <= high[mine].max()))
        other = other[np.lexsort((ids[other], ~row[other]))]
        falling = ~row[other]  # rising
        for w in mine:
            begin, end = np.searchsorted(falling, ~high[w], "left"), np.searchsorted(falling, ~low[w], "right")
            at = other[begin : min(end, begin + k)]
            yield number[w], row[at], at

    return _first(_read(pairs, batches.select("batch", "anchor_labels", "which", "number", "low", "high", "anchors"), block, search), k)


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and number, with rank."""
    order = W.partitionBy("batch", "anchor", "number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_windows(batches: DataFrame, found: DataFrame, low: str) -> DataFrame:
    """batches that have windows, with lists which (anchor), number, low, high: found has batch, anchor, rank, high and the named low."""
    lists = found.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(F.col("anchor").alias("which"), F.col("rank").alias("number"), F.col(low).alias("low"), "high"))).alias("w"))
    lists = lists.select("batch", *[F.col("w")[c].alias(c) for c in ("which", "number", "low", "high")])
    return batches.select("batch", "anchor_labels", "anchors").join(lists.hint("merge"), "batch")


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, block_rows: int = 2048, page_blocks: int = 256, lead: int = 4) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: vec_id, label, embedding.

    Anchors are the rows whose vec_id is divisible by `every`. Rows take no part whose label is null or whose vector is null, empty, of other than
    the commonest length, or holds null or non-finite entries. Rows without vec_id are candidates behind all ties, never anchors. Rows that repeat
    count each for itself: a copy of an anchor is one of its positives, and each copy of an anchor has rows of its own. An anchor without
    positives, and a positive whose window is empty, has no row. Scores beyond 64 bits stay at their ends. No rows give no rows.
    Tasks hold one block and one batch, of block_rows rows at most; the driver two numbers a dimension.
    """
    spark = rows.sparkSession
    with scratch(spark) as made:
        valid = finite(rows.where("label is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding"), "embedding")
        _, sums = by_dimension(valid, "embedding", mean=F.avg("v"), spread=F.stddev_pop("v"))
        d = len(sums)
        ids = valid.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(1).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("vec_id").alias("positive_score"), F.col("vec_id").alias("negative_score"))
        if not d:
            return ids.where(F.lit(False))
        spread = [0.0 if r["spread"] is None or not math.isfinite(r["spread"]) else r["spread"] for r in sums]
        mean = [r["mean"] if r["mean"] is not None and math.isfinite(r["mean"]) else 0.0 for r in sums]
        dims = sorted(range(d), key=lambda i: (-spread[i], i))[:HILBERT_DIMS]
        width = [6 * spread[i] or 1.0 for i in dims]
        keyed = sort_keys(valid.where(F.size("embedding") == d), d, dims, [mean[i] - w / 2 for i, w in zip(dims, width, strict=True)], width)
        keyed = staged(keyed, "keyed")
        block = staged(blocks(keyed, block_rows), "blocks")
        batches = staged(batches_of(block, every, positives), "batches")
        pages, n_pages = zone_pages(block, page_blocks)

        pairs = staged(positive_pairs(batches, pages, n_pages), "positive-pairs")
        best = staged(read_positives(pairs, batches, block, positives).drop("number"), "positives")
        window = best.withColumns({"low": F.ceil(F.col("score").cast("decimal(20,0)") / 2).cast("bigint"), "high": F.floor(F.col("score").cast("decimal(22,0)") * 95 / 100).cast("bigint")}).where("low <= high")
        asked = staged(with_windows(batches, window, "low"), "windows")

        near = negative_bounds(asked, pages, n_pages, lead)
        order = W.partitionBy("batch", "anchor").orderBy(F.desc("upper"), "block")
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= lead)
        near = staged(near.groupBy("batch", "block").agg(F.sort_array(F.collect_list("anchor")).alias("which")), "leading-pairs")
        third = read_negatives(near, asked, block, negatives).where(F.col("rank") == negatives)
        third = staged(third.select("batch", "anchor", F.col("number").alias("rank"), F.col("score").alias("known")), "known")
        window = window.join(third.hint("merge"), ["batch", "anchor", "rank"], "left").withColumn("from", F.coalesce("known", "low"))
        asked = staged(with_windows(batches, window, "from"), "windows")

        pairs = staged(negative_pairs(asked, pages, n_pages), "negative-pairs")
        worst = staged(read_negatives(pairs, asked, block, negatives), "negatives")
        anchors = batches.select("batch", F.posexplode("anchor_ids").alias("anchor", "anchor_id"))
        best = best.select("batch", "anchor", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = worst.join(best.hint("merge"), ["batch", "anchor", "number"]).join(staged(anchors, "anchors").hint("merge"), ["batch", "anchor"])
        out = staged(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
        made.keep(out)
    return out


#: Every seventh vector gets the next label.
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def mined(embeddings: DataFrame) -> DataFrame:
    """hard_negatives of embeddings (vec_id, embedding, label), with changed labels as in LABEL."""
    return hard_negatives(embeddings.select("vec_id", F.expr(LABEL).alias("label"), "embedding"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, {LABEL} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS r
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, b.r AS other, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST, other) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id NULLS LAST, s.other) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
