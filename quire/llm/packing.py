"""Operator 5: best-fit packing by large-item matching.

Documents become token ids, and only longer ones are cut into pieces of the capacity. Bins are planned on
the histogram of piece lengths, which has at most `capacity` entries whatever the number of documents:
lengths above a third of the capacity pair at most twice a bin, the largest with the largest that fits;
smaller lengths then go, in falling order, where the least room is left that holds them. The plan says
which bins take the r-th piece of each length; pieces are numbered within their length without a sort.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.shared import handing_back, n_parts, new_folder, staged
from quire.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit), the writing task and the piece's place among that task's pieces of its length."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for batch in batches:
            rows, size = [], 0
            doc_ids = batch.column(0)
            for i, ids in enc.column(batch.column(1)):
                doc_id = doc_ids[i].as_py()
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length].tobytes()
                    rows.append((doc_id, k, start, length, zlib.crc32(own), own, part, int(seen[length])))
                    seen[length] += 1
                    size += length
                if size > 1 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(handing_back(run), _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Place counts[length] pieces of each length. Returns the placements and the number of bins.

    A placement (length, first, n, bin, per_bin, offset): pieces first .. first+n-1 of that length go to
    bins from `bin` on, per_bin in each, the first of a bin at `offset`.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins (first, n)
    rooms: list[int] = []  # the keys of gaps, ascending
    bins = 0

    def put(length: int, n: int, at: int, per_bin: int, offset: int) -> None:
        out.append((length, used[length], n, at, per_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(room: int, at: int, n: int) -> None:
        if n and room:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((at, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1  # the largest partner that fits
        if i < 0:
            n, b = left[a], 0
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:  # one of this length is left over
                n, b = left[a], large[i - 1] if i else 0
                n = min(n, left[b]) if b else n
        put(a, n, bins, 1, 0)
        if b:
            put(b, n, bins, 1, a)
        leave(capacity - a - b, bins, n)
        bins += n
        large = [k for k in large if left[k]]
    for a in sorted((k for k in left if left[k]), reverse=True):
        while left[a]:
            i = bisect.bisect_left(rooms, a)
            if i == len(rooms):
                each = capacity // a
                whole, rest = divmod(left[a], each)
                for m, per in ((whole, each), (1 if rest else 0, rest)):
                    if m:
                        put(a, m * per, bins, per, 0)
                        leave(capacity - per * a, bins, m)
                        bins += m
                break
            room = rooms[i]
            at, n = gaps[room].pop()
            each = room // a
            whole, rest = divmod(min(left[a], n * each), each)
            if whole:
                put(a, whole * each, at, each, capacity - room)
                leave(room - each * a, at, whole)
            if rest:
                put(a, rest, at + whole, rest, capacity - room)
                leave(room - rest * a, at + whole, 1)
            over = whole + (1 if rest else 0)
            if n > over:
                gaps[room].append((at + over, n - over))
            if not gaps[room]:
                del gaps[room]
                rooms.remove(room)
    return out, bins


def pack_pieces(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """made: the written rows of pieces(). Adds sequence_id and offset; other columns go along."""
    spark = made.sparkSession
    counts = staged(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    placements, _ = plan(histogram, capacity)
    table = np.array(sorted(placements), np.int64).reshape(-1, 6)
    keys = table[:, 0] << 44 | table[:, 1]
    shared = spark.sparkContext.broadcast((keys, table))  # a few placements a length: bounded by the capacity
    # How many pieces of a length the tasks before have: a table that tasks read for their own rows, so no piece shuffles.
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    folder = new_folder(spark, "bases")
    bases.repartitionByRange(n_parts(spark), "part").sortWithinPartitions("part", "length").write.parquet(folder)
    # A part's rows lie in one file; which one is told by its first part, so that tasks open no others.
    files = spark.read.schema("part int").parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("part").alias("first"))
    files = sorted((r["first"], r["file"]) for r in files.collect())  # a row a shuffle partition

    def bases_of(part: int) -> np.ndarray:
        fs, where = pafs.FileSystem.from_uri(files[bisect.bisect_right(files, part, key=lambda x: x[0]) - 1][1])
        with fs.open_input_file(where) as f:
            own = pq.ParquetFile(f).read(["part", "length", "before"])
        mine = own.column(0).to_numpy() == part
        out = np.zeros(capacity + 1, np.int64)
        out[own.column(1).to_numpy()[mine]] = own.column(2).to_numpy()[mine]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        last, base = None, None
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
            length, part, rank = get("length"), get("part"), get("place").copy()
            for x in np.unique(part).tolist():  # one or two: the tasks whose rows this one reads
                if x != last:
                    last, base = x, bases_of(x)
                rank[part == x] += base[length[part == x]]
            _, first, _, at, per, offset = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            bin_no, place = np.divmod(rank - first, np.maximum(per, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in own), pa.array(at + bin_no), pa.array(offset + place * length)], names=[*own, "sequence_id", "offset"])

    own = [n for n in made.columns if n not in ("part", "place")]
    fields = [f"`{n}` {t}" for n, t in made.dtypes if n in own]
    return made.mapInArrow(handing_back(run), ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (if wanted), sequence_id, offset.

    Null and empty texts are one piece that holds the end id only. Rows that repeat a doc_id are packed each
    for itself. No rows give no rows. Every piece lies in one sequence, and offsets leave no gap from 0. Whole texts of
    any length are encoded. Other columns of docs are not read.
    """
    made = staged(pieces(docs, capacity, tokenizer), "pieces")
    return pack_pieces(made if with_ids else made.drop("ids"), capacity)
