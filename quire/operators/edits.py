"""Edit distances of many pairs of texts at once: Myers' bit vectors, a column of numpy arrays a character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LANES, TABLE = 2048, 4 << 20  # pairs, and 64-bit words of character tables, that are computed at once, at most
SIZES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32])  # words of pattern that pairs are rounded up to
CHARS = 4_000_000  # characters that are held as numbers at once, or those of one pair


def portions(a: list[str | None], b: list[str | None]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(first place, pairs) of runs of pairs with CHARS characters at most; a missing text is empty."""
    first, own, held = 0, [], 0
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        size = len(x or "") + len(y or "")
        if own and held + size > CHARS:
            yield first, own
            first, own, held = i, [], 0
        own.append((x or "", y or ""))
        held += size
    if own:
        yield first, own


def numbered(text: str) -> np.ndarray:
    """Its characters as numbers from 1."""
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(flat.max(initial=0)) + 1, bool)
    seen[flat] = True
    return np.cumsum(seen)[flat]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts as numbers, where each text begins, lengths)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    return numbered("".join(texts)), np.cumsum(length) - length, length


def _together(codes: np.ndarray, p: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray, free: bool, size: int) -> np.ndarray:
    """bottom_rows of pairs whose patterns are of equally many words; unless free, distances of pairs whose texts come by length. Places past a pattern's or text's end hold 0 and change nothing before them."""
    lanes, most, words = len(p), int(n.max()), (int(m.max()) + 63) // 64
    k = np.arange(max(most, int(m.max())))[:, None]
    of = lambda at, length, upto: np.where(k[:upto] < length, codes[np.minimum(at + k[:upto], len(codes) - 1)], 0) + np.arange(lanes) * size
    table, pattern, text = np.zeros((words, lanes * size), np.uint64), of(p, m, int(m.max())), of(t, n, most)
    for j, at in enumerate(pattern):
        table[j // 64, at] |= np.uint64(1 << j % 64)
    up, down = np.full((words, lanes), ~np.uint64(0)), np.zeros((words, lanes), np.uint64)
    one, top, end = np.uint64(1), np.uint64(63), ((m - 1) % 64).astype(np.uint64)
    out = np.empty((most + 1 if free else 1, lanes), np.int32)
    out[0] = m
    eq, xv, xh, ph, mh, *edges = np.empty((9, lanes), np.uint64)
    score, done = m.astype(np.uint64), np.searchsorted(n, np.arange(most + 2))  # of texts by length
    inside = np.where(np.arange(words)[:, None] < m // 64, ~np.uint64(0), np.where(np.arange(words)[:, None] > m // 64, 0, (one << (m % 64).astype(np.uint64)) - one))
    for i, at in enumerate(text):
        plus, minus = edges[:2]
        plus[:], minus[:] = 0 if free else 1, 0
        for w in range(words):
            pv, mv = up[w], down[w]
            table[w].take(at, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            if w:
                eq |= minus
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            if w == words - 1 and free:
                np.right_shift(ph, end, out=xh)
                xh &= one
                score += xh
                np.right_shift(mh, end, out=xh)
                xh &= one
                score -= xh
                out[i + 1] = score
            elif w < words - 1:
                after = edges[2:] if w % 2 == 0 else edges[:2]
                np.right_shift(ph, top, out=after[0])
                np.right_shift(mh, top, out=after[1])
            ph <<= one
            ph |= plus
            mh <<= one
            mh |= minus
            np.bitwise_and(ph, xv, out=mv)
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(mh, xv, out=pv)
            if w < words - 1:
                plus, minus = after
        own = slice(done[i + 1], done[i + 2])
        if not free and own.stop > own.start:
            steps = np.bitwise_count(up[:, own] & inside[:, own]).sum(0, np.int64) - np.bitwise_count(down[:, own] & inside[:, own]).sum(0, np.int64)
            out[0, own] = i + 1 + steps
    return out if free else out[0]


def _table(pattern: list[int]) -> dict[int, int]:
    if len(pattern) > 2000:  # each shift would be as long as the pattern
        own = np.array(pattern)
        return {int(c): int.from_bytes(np.packbits(own == c, bitorder="little").tobytes(), "little") for c in np.unique(own)}
    table: dict[int, int] = {}
    for j, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << j
    return table


def _alone(pattern: list[int], text: list[int]) -> np.ndarray:
    """Free bottom_rows of one pair, by Python's long numbers."""
    table, every, top = _table(pattern), (1 << len(pattern)) - 1, len(pattern) - 1
    pv, mv, score, out = every, 0, len(pattern), [len(pattern)]
    for c in text:
        eq = table.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (every & ~(xh | pv)), pv & xh
        score += (ph >> top & 1) - (mh >> top & 1)
        out.append(score)
        ph, xv = ph << 1, eq | mv
        pv, mv = (mh << 1 | ~(xv | ph)) & every, ph & xv & every
    return np.array(out, np.int32)[:, None]


def _one_distance(pattern: list[int], text: list[int]) -> int:
    table, every = _table(pattern), (1 << len(pattern)) - 1
    pv, mv, get = every, 0, table.get
    for c in text:
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, xv = (mv | (every ^ ((xh | pv) & every))) << 1 | 1, eq | mv
        pv, mv = ((pv & xh) << 1 | (every ^ ((xv | ph) & every))) & every, ph & xv & every
    return len(text) + pv.bit_count() - mv.bit_count()


def _groups(words: np.ndarray, n: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Numbers of pairs with as many words of pattern and texts of like length, by length, and whether they are enough to be computed together."""
    order = np.lexsort((n, words))
    for own in np.split(order, np.flatnonzero(np.diff(words[order])) + 1) if len(order) else []:
        w, i = int(words[own[0]]), 0
        while i < len(own):
            upto = np.searchsorted(n[own], n[own[i]] * 1.4 + 16, "right")
            some = own[i : min(upto, i + max(1, min(LANES, TABLE // (w * size))))]
            yield some, len(some) >= 25 * w  # below that a call of numpy for each word costs more
            i += len(some)


def bottom_rows(codes: np.ndarray, p: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of some pairs, distances): row j holds the distance of each one's pattern to whichever end of the first j characters of its text is nearest.

    A pair is the pattern of m characters from place p of codes on, m at least 1, and the text of n from place t on. Pairs of like sizes are computed
    together, and those too few for that one by one. Rows past a pair's own n mean nothing.
    """
    size = int(codes.max(initial=0)) + 1
    for some, many in _groups((m + 63) // 64, n, size):
        if many:
            yield some, _together(codes, p[some], m[some], t[some], n[some], True, size)
            continue
        for x in some:
            yield np.array([x]), _alone(codes[p[x] : p[x] + m[x]].tolist(), codes[t[x] : t[x] + n[x]].tolist())


def distances(codes: np.ndarray, p: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distance of each pair."""
    out, size = np.maximum(m, n), int(codes.max(initial=0)) + 1
    p, m, t, n = np.where(m <= n, (p, m, t, n), (t, n, p, m))
    both = np.flatnonzero(m > 0)
    words = SIZES[np.minimum(np.searchsorted(SIZES, (m[both] + 63) // 64), len(SIZES) - 1)]
    for some, many in _groups(np.where(m[both] > 64 * SIZES[-1], (m[both] + 63) // 64, words), n[both], size):
        own = both[some]
        if many:
            out[own] = _together(codes, p[own], m[own], t[own], n[own], False, size)
            continue
        for x in own:  # the long numbers take the longer one, since each character of the other is a step
            out[x] = _one_distance(codes[t[x] : t[x] + n[x]].tolist(), codes[p[x] : p[x] + m[x]].tolist())
    return out


def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    a, b = a.to_pylist(), b.to_pylist()
    out = np.zeros(len(a), np.int32)
    for first, pairs in portions(a, b):
        k = len(pairs)
        codes, at, length = coded([x for x, _ in pairs] + [y for _, y in pairs])
        differ = np.flatnonzero([x != y for x, y in pairs])
        out[first + differ] = distances(codes, at[differ], length[differ], at[k + differ], length[k + differ])
    return pa.array(out, mask=np.array([x is None or y is None for x, y in zip(a, b, strict=True)], bool))


def edit_distance(a: Column, b: Column) -> Column:
    """As levenshtein, for long texts in large numbers; null where one is null."""
    return F.arrow_udf(_distance, "int")(a, b)
