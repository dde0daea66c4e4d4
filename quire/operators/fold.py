"""Folds over a key's rows in order, where each result depends on those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def carried(rows: DataFrame, key: str, order: list[str], run: Callable, out: str, kind: T.DataType) -> DataFrame:
    """rows plus out. run(state, part) gives (values, state) of a run of one key's rows, a pyarrow table; state is None before a key's first row.

    Rows are dealt out by key and sorted; a task goes through them once, a batch's runs as arrays, and carries the state from batch to batch.
    """
    at = rows.columns.index(key)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at).to_pandas()
            codes = keys.factorize(use_na_sentinel=False)[0]
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), b.num_rows]
            values = []
            for i, j in zip(cuts, cuts[1:]):  # noqa: B905
                own = (b.column(at)[i].as_py(),)
                state = state if own == last else None
                last = own
                part, state = run(state, pa.table(b.slice(i, j - i)))
                values.append(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(values))], names=[*b.schema.names, out])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(task, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))


def first_false(test: Callable[[int, int], np.ndarray], at: int, end: int) -> int:
    """The first place from `at` on where test fails, or end. test(i, j) is asked for ever longer runs, so that a long run costs few steps."""
    width = 16
    while at < end:
        stop = min(at + width, end)
        bad = np.flatnonzero(~test(at, stop))
        if len(bad):
            return at + int(bad[0])
        at, width = stop, width * 4
    return end


def covered(y: np.ndarray, lo: np.ndarray, hi: np.ndarray, last: tuple | None, within: float, overlap: float) -> tuple[np.ndarray, tuple | None]:
    """(which segments are kept, the one kept last) of segments in order: one goes if the one kept last covers it. One step for each kept segment."""
    kept, at = np.zeros(len(y), bool), 0
    while at < len(y):
        if last is not None:
            y0, lo0, hi0 = last
            at = first_false(lambda i, j: (np.abs(y0 - y[i:j]) <= within) & (np.minimum(hi0, hi[i:j]) - np.maximum(lo0, lo[i:j]) > overlap * (hi[i:j] - lo[i:j])), at, len(y))  # noqa: B023
            if at == len(y):
                break
        kept[at], last = True, (float(y[at]), float(lo[at]), float(hi[at]))
        at += 1
    return kept, last


def visual_rows(y: np.ndarray, state: tuple[float, int] | None, within: float) -> tuple[np.ndarray, tuple[float, int] | None]:
    """(row numbers from 1, (y of the last row, its number)) of words by rising y: a word joins a row if it lies within `within` of the row's y, which moves half way to it."""
    mean, row = state or (float("-inf"), 0)
    out = np.empty(len(y), np.int32)
    for i, v in enumerate(y.tolist()):  # each mean depends on the one before
        if v - mean <= within:
            mean = (mean + v) / 2
        else:
            mean, row = v, row + 1
        out[i] = row
    return out, (mean, row) if row else None


def grants(us: np.ndarray, cost: np.ndarray, state: tuple[int, int] | None, size: int, span: int) -> tuple[np.ndarray, tuple[int, int] | None]:
    """(which calls are granted, state after them) of calls in order; state: (begin, credits left) of the last bucket.

    A bucket of `size` credits holds for `span` from its first call, refused calls cost nothing. The work is one step a bucket, and one for
    each time that credits don't last: a call is found by bisection in the running sum, not met one by one.
    """
    out, upto = np.zeros(len(us), bool), np.concatenate([[0], np.cumsum(cost)])
    at = 0
    since, left = state or (None, size)
    while at < len(us):
        if since is None or us[at] - since > span:
            since, left = us[at], size
        end = int(np.searchsorted(us, since + span, "right"))
        end = max(end, at + 1)
        while at < end:
            stop = min(int(np.searchsorted(upto, upto[at] + left, "right")) - 1, end)
            out[at:stop] = True
            left -= upto[stop] - upto[at]
            more = np.flatnonzero(cost[stop:end] <= left)  # what comes next that the rest still pays for
            at = stop + int(more[0]) if len(more) else end
    return out, (since, left) if since is not None else None
