"""Texts of an Arrow batch as one byte array, and hashes of their words and n-grams by NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
STEP = 1 << 18  # bytes that are looked at together, unless one text is longer
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, STEP + (1 << 16)), U(base))
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
        if len(_powers[base]) > 4 * STEP:  # for one long text only
            return _powers.pop(base)[:n]
    return _powers[base][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits look random."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of the first i bytes modulo 2^64."""
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(_BYTE[data] * _power(_MUL, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end; equal bytes have equal hashes."""
    return mix64((h[end] - h[start]) * _power(_INV, len(h))[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k bytes."""
    n = len(h) - k
    return mix64((h[k:] - h[:n]) * _power(_INV, len(h))[:n])


def texts(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of about step bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if len(column) else column
    if not len(column):
        return
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may hold bytes
        size = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if size.sum() != off[-1] - off[0]:
            data = np.concatenate([data[a : a + n] for a, n in zip(off[:-1], size, strict=True)] or [data[:0]])
            off = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+, and the number of words before each text (one more than texts)."""
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    first = off[:-1][off[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)
