"""Operator 8: removal of repeated byte strings by a distributed sparse suffix array.

A byte goes if a string of LENGTH bytes covers it that also starts earlier (smaller doc_id, or the same
document, further left). Every such string holds GRAM-byte grams; the one of least hash is its anchor, which
depends on the string alone, so equal strings have equal anchors at equal distance. The suffixes looked at
are those at anchors, one for about 26 bytes; each stands for the run of strings that share it.

1. Suffixes are grouped by the hash of their first GRAM bytes. A suffix alone in its group drops out; one
   that repeats another's whole run is a repeat; the first suffixes of groups with different runs remain.
2. Those are range-partitioned by their leading bytes with sampled splitters. Buckets sort the strings of
   their runs by multikey quicksort, eight bytes a character, and all but the first of equal strings go.
   Equal leading bytes always fall into one bucket, so strings on two sides of a border differ in them.
   Leads of more than HOT_RUNS runs are dealt out further: their strings themselves, whole, are range-partitioned
   by sampled splitters and sorted, and each is compared with the one before it, so no lead has to fit in memory.
3. The intervals found are merged per document and cut out.

Whole copies of an earlier document are told by their hash beforehand and take no part in 1 and 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.bytetext import U, mix64, prefix_hash, span_hash, texts, window_hash
from quire.llm.shared import BROADCAST_ROWS, global_row_number, n_parts, scratch, sent, staged

LENGTH, GRAM, LEAD = 100, 50, 16
HOT_RUNS = 20_000  # of one lead that a task sorts at once, about 2.5 KB each


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (text, first start, last start, anchor, hash of the gram, hash of the run)."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    h = prefix_hash(data)
    grams = window_hash(h, gram)
    bits = max(24, len(data).bit_length())
    least = grams & ~U((1 << bits) - 1) | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    at = (least & U((1 << bits) - 1)).astype(np.int64)  # the anchor of the string that starts here
    valid = np.ones(n, bool)
    for a, b in zip(np.maximum(off[1:-1] - length + 1, 0).tolist(), off[1:-1].tolist(), strict=True):
        valid[a:b] = False
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & change)
    stop = np.ones(n, bool)
    stop[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    anchor = at[first]
    run = span_hash(h, first, last + length) + mix64((anchor - first).astype(np.uint64))
    return np.searchsorted(off, first, "right") - 1, first, last, anchor, grams[anchor], run


def _suffixes(rows: DataFrame) -> DataFrame:
    """key, run, doc, at (start of the run, shifted by 16 bits, and its number of strings), known of all anchors.

    Of the same runs that a task sees together, all but the first are known to be repeats: they meet no
    others, and a key of their own deals them out evenly however common the run is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for i, data, off in texts(batch.column(1), 1 << 20):  # the more at once, the more repeats are known before the shuffle
                text, first, last, _, key, run = anchors(data, off)
                at, d = (first - off[text]) << 16 | (last - first + 1), doc[i + text]
                both = mix64(key + mix64(run))
                order = np.lexsort((at, d, both))
                known = np.zeros(len(order), bool)
                known[order[1:]] = both[order[1:]] == both[order[:-1]]
                key = np.where(known, mix64(both + mix64(d.view(np.uint64)) + at.astype(np.uint64)), key)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), pa.array(d), pa.array(at), pa.array(known)], names=["key", "run", "doc", "at", "known"])

    return rows.select("doc", "text").mapInArrow(run, "key long, run long, doc long, at long, known boolean")


def repeated_suffixes(rows: DataFrame) -> DataFrame:
    """doc, at, first (the first suffix of its run; else it repeats one) of the suffixes whose gram repeats."""
    key = W.partitionBy("key", "known")
    order = key.orderBy("run", "doc", "at")
    new = F.lag("run").over(order).isNull() | (F.lag("run").over(order) != F.col("run"))
    out = _suffixes(rows).withColumn("first", ~F.col("known") & new)
    out = out.withColumn("several", ~F.col("known") & (F.min("run").over(key) != F.max("run").over(key)))
    return staged(out.where(F.col("several") | ~F.col("first")).select("doc", "at", "first"), "suffixes")


def _open_runs(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """lead, doc, start, text of the runs of first suffixes; lead is what the suffix begins with."""
    own = suffixes.where("first").groupBy("doc").agg(F.collect_list("at").alias("ats"))  # no longer than the document
    both = rows.select("doc", "text").join(own.hint("merge"), "doc").select("doc", "text", "ats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for i, data, off in texts(batch.column(1)):
                ats = batch.column(2).slice(i, len(off) - 1)
                text = np.repeat(np.arange(len(off) - 1), np.diff(ats.offsets.to_numpy()))
                at = ats.flatten().to_numpy()
                start, size = at >> 16, (at & 0xFFFF) + LENGTH - 1
                found = anchors(data, off)  # the anchor of each run again
                where = np.searchsorted(found[1], off[text] + start)
                anchor, raw = found[3][where], data.tobytes()
                begin = (off[text] + start).tolist()
                lead = [raw[a : a + LEAD] for a in anchor.tolist()]
                body = [raw[a : a + n] for a, n in zip(begin, size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary()), pa.array(doc[i + text]), pa.array(start), pa.array(body, pa.binary())], names=["lead", "doc", "start", "body"])

    return both.mapInArrow(run, "lead binary, doc long, start long, body binary")


def multikey_sort(words: np.ndarray, at: np.ndarray, depth: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sort positions by the characters words[at + d] for d in depth.

    Returns the positions that equal another, in order, and their class numbers. Each level splits all open
    partitions by the next character and closes those of one member.
    """
    part = np.zeros(len(at), np.int64)
    for d in depth:
        char = words[at + d]
        order = np.lexsort((char, part))
        at, part, char = at[order], part[order], char[order]
        new = np.ones(len(at), bool)
        new[1:] = (part[1:] != part[:-1]) | (char[1:] != char[:-1])
        part = np.cumsum(new) - 1
        size = np.bincount(part, minlength=1)
        more = size[part] > 1 if len(part) else np.zeros(0, bool)
        at, part = at[more], part[more]
        if not len(at):
            break
    return at, part


def repeats_in(bodies: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the repeats among all strings of the runs."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    raw = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    words = np.zeros(len(raw) - 7, np.uint64)
    for j in range(8):
        words = words << U(8) | raw[j : len(raw) - 7 + j]
    off = np.cumsum(size) - size
    n = size - LENGTH + 1
    owner = np.repeat(np.arange(len(bodies)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at, part = multikey_sort(words, off[owner] + inner, [*range(0, LENGTH - 7, 8), LENGTH - 8])
    own = np.searchsorted(off, at, "right") - 1
    d, s = doc[own], start[own] + at - off[own]
    order = np.lexsort((s, d, part))
    part, d, s = part[order], d[order], s[order]
    again = np.zeros(len(part), bool)
    again[1:] = part[1:] == part[:-1]
    d, s = d[again], s[again]
    return d, s, s + LENGTH


def _bucket_repeats(opened: DataFrame) -> DataFrame:
    """doc, start, end: strings that repeat an earlier one, neighbours merged. Runs with one lead stay together."""
    n = n_parts(opened.sparkSession)
    ranged = opened.repartitionByRange(n, "lead").sortWithinPartitions("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, bytes]] = []
        size = 0

        def done(rows: list) -> pa.RecordBatch:
            _, d, s, b = zip(*rows, strict=True)
            doc, start, end = repeats_in(list(b), np.array(d, np.int64), np.array(s, np.int64))
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
            stop = np.flatnonzero(np.append(new[1:], True)) if len(doc) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(start[new]), pa.array(end[stop])], names=["doc", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > 1 << 20 and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    return ranged.mapInArrow(run, "doc long, start long, end long")


def _hot_repeats(opened: DataFrame) -> DataFrame:
    """doc, start, end: as _bucket_repeats, string by string and without holding any."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, doc, start, known of all strings. Of equal ones that a task sees together, all but the first are known to be repeats and have a short key of their own."""
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = batch.slice(k, 256)
                seen: dict[bytes, int] = {}
                key, doc, start, known = [], [], [], []
                rows = sorted(zip(own.column(1).to_pylist(), own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True))
                for d, s, body in rows:
                    for i in range(len(body) - LENGTH + 1):
                        x = body[i : i + LENGTH]
                        known.append(x in seen)
                        seen[x] = 1
                        key.append(hashlib.blake2b(f"{d}:{s + i}".encode(), digest_size=8).digest() if known[-1] else x)
                        doc.append(d)
                        start.append(s + i)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(known)], names=["key", "doc", "start", "known"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key = batch.column(0).to_pylist()
            again = np.array([k or x == y for k, x, y in zip(batch.column(3).to_pylist(), key, [last, *key[:-1]], strict=True)], bool)
            last = key[-1] if key else last
            start = batch.column(2).to_numpy()[again]
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(again)), pa.array(start), pa.array(start + LENGTH)], names=["doc", "start", "end"])

    rows = opened.mapInArrow(strings, "key binary, doc long, start long, known boolean")
    ranged = rows.repartitionByRange(n_parts(opened.sparkSession), "key").sortWithinPartitions("key", "doc", "start")
    return ranged.mapInArrow(repeats, "doc long, start long, end long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, doc_id, text; whether doc repeats). doc is a number that orders documents: the doc_id unless that repeats."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows, False
    hashed = rows.withColumn("__h", F.xxhash64("text"))
    distinct = hashed.select("doc", "__h").distinct().withColumn("__k", F.struct("doc", "__h"))
    number = staged(global_row_number(distinct, "__k", "__n", "numbers").select(F.col("doc").alias("__d"), F.col("__h").alias("__t"), "__n"), "numbers")
    both = hashed.join(number.hint("merge"), (F.col("doc") == F.col("__d")) & (F.col("__h") == F.col("__t")))
    return staged(both.select(F.col("__n").cast("long").alias("doc"), "doc_id", "text"), "numbered"), True


def _copies(rows: DataFrame) -> DataFrame:
    """doc of every document whose whole text equals an earlier one's."""
    digests = staged(rows.select("doc", F.sha2("text", 256).alias("h")), "digests")
    first = staged(digests.groupBy("h").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first"), "firsts")
    return staged(digests.join(first.hint("merge"), "h").where("doc > first").select("doc").distinct(), "copies")


def substring_dedup(docs: DataFrame, with_kept: bool = True, hot_runs: int = HOT_RUNS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if wanted.

    Null text is empty. Documents that share a doc_id are ordered by a hash of their texts; rows that repeat
    a doc_id with its text are one document, and each gets its result. A null doc_id comes before all others.
    No rows give no rows. Whole texts are read; a text takes about 60 bytes of a task's memory for each of its own.
    Other columns of docs are not read. Copies of whole documents are sent to all tasks up to broadcast_rows of
    them; beyond, they are merged.
    """
    with scratch(docs.sparkSession) as made:
        out = _cut(docs, with_kept, hot_runs, broadcast_rows)
        made.keep(out)
    return out


def _cut(docs: DataFrame, with_kept: bool, hot_runs: int, broadcast_rows: int) -> DataFrame:
    rows, repeat = _numbered(docs)
    copies = sent(_copies(rows), broadcast_rows)
    fresh = rows.join(copies, "doc", "left_anti")
    fresh = fresh.dropDuplicates(["doc"]) if repeat else fresh
    suffixes = repeated_suffixes(fresh)
    opened = staged(_open_runs(fresh, suffixes), "runs")
    hot = staged(opened.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_runs).select("lead"), "hot-leads")
    if hot.isEmpty():
        found = _bucket_repeats(opened)
    else:  # at most one lead in hot_runs runs
        hot = sent(hot, broadcast_rows)
        found = _bucket_repeats(opened.join(hot, "lead", "left_anti")).unionByName(_hot_repeats(opened.join(hot, "lead", "left_semi")))
    start = F.shiftright("at", 16)
    again = suffixes.where(~F.col("first")).select("doc", start.alias("start"), (start + F.col("at").bitwiseAND(0xFFFF) + LENGTH - 1).alias("end"))
    spans = again.unionByName(found).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # no longer than the document
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 62).alias("end")))
    spans = spans.unionByName(copies.select("doc", whole.alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            spans = batch.column(2)
            for i, data, off in texts(batch.column(1)):
                raw = data.tobytes()
                for j in range(len(off) - 1):
                    own = raw[off[j] : off[j + 1]]
                    cut = merged(spans[i + j].values, len(own)) if spans[i + j].is_valid else []
                    kept, last = [], 0
                    for a, b in cut:
                        kept.append(own[last:a])
                        last = b
                    kept = b"".join([*kept, own[last:]])
                    for x, v in zip(out, (len(own), len(own) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            n = len(names) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out[:n], kinds[:n], strict=True))], names=names)

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    names = [x.split()[0] for x in kind.split(", ")]
    both = rows.join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans")
    return staged(both.mapInArrow(run, kind), "cut-texts")


def merged(spans: pa.Array, n: int) -> list[tuple[int, int]]:
    """Maximal intervals of a document of n bytes."""
    if n < LENGTH:
        return []
    start, end = spans.field(0).to_numpy(), np.minimum(spans.field(1).to_numpy(), n)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    stop = np.append(new[1:], True)
    return list(zip(start[new].tolist(), end[stop].tolist(), strict=True))
