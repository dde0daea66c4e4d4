"""Operator 9: toxic passages by maximum-scoring segments.

Token scores are log-odds of toxic against clean text with an informative Dirichlet prior (prior counts in
proportion to the token's share of all labelled text), less `z` standard errors; tokens
below `least` share one pooled score. A token is a lower-case word; a word without a score of its own takes that of its
prefix of 6, 5 or 4 letters. A linear scan finds all maximal scoring segments (Ruzzo and Tompa). The tail of
segment scores in clean text, of documents kept out of the token counts, gives the extreme-value law
E = K * words * exp(-lambda * score). Passages are the segments with E of `most_e` or less. A document's E
is that of the best r of them by the sum statistics of Karlin and Altschul, and its score is
1 / (1 + E / chance): one half where clean text has `chance` such documents' worth of segments by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytetext import LOWER, U, mix64, prefix_hash, span_hash, texts
from quire.llm.shared import scratch, staged

PREFIXES = (6, 5, 4)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, number of words before each text). hashes: a row for the word and each prefix; 0 where the word is not longer than the prefix."""
    low = LOWER[data]
    if len(low) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 32
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    h = prefix_hash(low)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    n_lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    rows = [span_hash(h, starts, ends)]
    for k in PREFIXES:
        more = n_lead[ends] - n_lead[starts] > k
        out = np.zeros(len(starts), np.uint64)
        first = n_lead[starts[more]]
        out[more] = mix64(span_hash(h, starts[more], lead[first + k]) + U(k))
        rows.append(out)
    return np.array(rows).view(np.int64), starts, ends, np.searchsorted(starts, off)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, in linear time.

    A segment that no held one starts lower than makes all held ones final: they leave the list that is searched. Each held segment
    links to the last one before it that starts lower, so that a search passes over those between for good.
    """
    out: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # first, last + 1, sum before, sum at its end, link
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        new, j = (i, i + 1, before, total), -1
        while held:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0:
                out += [(a, b, r - x) for a, b, x, r, _ in held]
                held = []
                break
            if held[j][3] >= new[3]:
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
            j = -1
        held.append((*new, j))
    return out + [(a, b, r - x) for a, b, x, r, _ in held]


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic, fold of at most about per_class labelled rows a class, outside the held-out third."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = staged(own.withColumn("h", F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(1 << 20))), "labels")
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, per_class / max(n.get(1, 0), 1)).otherwise(per_class / max(n.get(0, 0), 1))
    own = staged(own.where(F.col("h") < share * (1 << 20)).select(F.col("doc_id").cast("long").alias("__id"), "toxic", F.pmod("h", F.lit(5)).alias("fold")), "labels")
    # At most 2 * per_class rows of three numbers, whatever the size of the corpus.
    return docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(own), "__id").drop("__id")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def token_scores(train: DataFrame, prior: float = 0.01, z: float = 1.0, least: float = 2.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted hashes, their scores, the score of all other tokens).

    Every token that stands in 3 training documents and scores above least is kept: the table is bounded by the
    bounded sample, not by the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for i, data, off in texts(batch.column(0)):
                hashes, _, _, at = tokens(data, off)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
                for kind, h in enumerate(hashes):
                    whole = np.flatnonzero(h)  # a token counts once a document
                    whole = whole[np.unique(mix64(h[whole].view(np.uint64) + mix64(doc[whole].astype(np.uint64))), return_index=True)[1]]
                    f, back = np.unique(h[whole], return_inverse=True)
                    y1 = np.bincount(back, toxic[i + doc[whole]], len(f)).astype(np.int64)
                    n = np.bincount(back, minlength=len(f))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), kind, np.int32)), pa.array(f), pa.array(n - y1), pa.array(y1)], names=["kind", "f", "y0", "y1"])

    counted = staged(train.mapInArrow(run, "kind int, f long, y0 long, y1 long").groupBy("kind", "f").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1")), "tokens")
    n0, n1 = (counted.where("kind = 0").agg(F.sum("y0"), F.sum("y1")).first() or (0, 0))
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), -0.01
    a = prior * (F.col("y0") + F.col("y1"))
    a0 = prior * (n0 + n1)
    logit = lambda y, n: F.log((y + a) / (F.lit(float(n)) + a0 - y - a))
    delta = logit(F.col("y1"), n1) - logit(F.col("y0"), n0)
    se = F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    found = counted.where("y0 + y1 >= 3").withColumn("s", F.signum(delta) * F.greatest(F.abs(delta) - z * se, F.lit(0.0))).where(F.col("s") > least)
    found = staged(found.select("kind", "f", "s", "y0", "y1"), "token-scores")
    rest = found.where("kind = 0").agg(F.coalesce(F.sum("y0"), F.lit(0)), F.coalesce(F.sum("y1"), F.lit(0))).first()
    other = math.log(max(n1 - rest[1], 1) / n1) - math.log(max(n0 - rest[0], 1) / n0)
    table = found.select("f", "s").toArrow()  # of the sample's tokens
    f, s = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(f)
    return f[order], s[order], min(other, -0.01)


def passages(column: pa.Array, keys: np.ndarray, scores: np.ndarray, other: float) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(index of the text, words, [(start, end, score) in bytes]) for each text."""
    for i, data, off in texts(column):
        hashes, starts, ends, at = tokens(data, off)
        s = np.full(len(starts), np.nan)
        if len(keys):
            for h in hashes:
                todo = np.flatnonzero(np.isnan(s) & (h != 0))
                where = np.minimum(np.searchsorted(keys, h[todo]), len(keys) - 1)
                hit = keys[where] == h[todo]
                s[todo[hit]] = scores[where[hit]]
        s = np.where(np.isnan(s), other, s)
        positive = np.concatenate([[0], np.cumsum(s > 0)])
        for j in range(len(off) - 1):
            a, b = at[j], at[j + 1]
            found = segments(s[a:b]) if positive[b] > positive[a] else []
            yield i + j, int(b - a), [(int(starts[a + x] - off[j]), int(ends[a + y - 1] - off[j]), v) for x, y, v in found]


def tail(train: DataFrame, table: tuple[np.ndarray, np.ndarray, float], floor: float = 2.0, most: float = 6.0) -> tuple[float, float]:
    """(K, lambda) of the extreme-value law, from segments of clean text that score above floor, censored at floor + most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores, other = shared.value
        words = n = 0
        excess = 0.0
        for batch in batches:
            for _, w, found in passages(batch.column(0), keys, scores, other):
                words += w
                over = [v - floor for _, _, v in found if v > floor]
                n += sum(x < most for x in over)
                excess += sum(min(x, most) for x in over)
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([n], pa.int64()), pa.array([excess], pa.float64())], names=["words", "n", "excess"])

    shared = train.sparkSession.sparkContext.broadcast(table)
    sums = train.where("toxic = 0").select("text").mapInArrow(run, "words long, n long, excess double").agg(F.sum("words"), F.sum("n"), F.sum("excess")).first()
    words, n, excess = (x or 0 for x in sums)
    lam = min(2.0, (n + 5) / (excess + 5))  # as if five more had been seen, one above the floor on average
    return (n + 5) / max(words, 100_000) * math.exp(lam * floor), lam


def document_e(scores: np.ndarray, words: int, k: float, lam: float) -> float:
    """E-value of a document from its segments' scores: the least over r of that of its r best, doubled for each after the first.

    The r best have, by their normalised sum t, P = exp(-t) t^(r-1) / (r! (r-1)!).
    """
    x = lam * np.sort(np.append(scores, 0.0))[::-1] - math.log(k * (words + 100))
    e, t = math.exp(-x[0]), x[0]
    for r, more in enumerate(x[1:], 2):
        if more <= 0 or t <= 0:
            break
        t += more
        e = min(e, math.exp((r - 1) * math.log(2 * t) - t - math.lgamma(r + 1) - math.lgamma(r)))
    return e


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 40_000, threshold: float = 0.7, chance: float = 0.02, most_e: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, passages (start, end in bytes, score).

    Learns from at most about per_class labelled documents a class, none of them held out. Null and empty
    texts, and texts without scoring words, score near 0. A doc_id with several labels counts as toxic if one is.
    Without labels of both classes no score passes the threshold. Rows that repeat a doc_id are scored each for
    itself, equal texts alike. No rows give no rows. Whole texts are read; a text takes about 60 bytes of a task's
    memory for each of its own. Other columns of docs and labels are not read.
    """
    with scratch(docs.sparkSession) as made:
        out = _scored(docs, labels, per_class, threshold, chance, most_e)
        made.keep(out)
    return out


def _scored(docs: DataFrame, labels: DataFrame, per_class: int, threshold: float, chance: float, most_e: float) -> DataFrame:
    train = staged(training_rows(docs, labels, per_class), "training")
    table = token_scores(train.where("fold > 0"))
    k, lam = tail(train.where("fold = 0"), table)
    table = token_scores(train)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores, other = shared.value
        for batch in batches:
            out, spans = [], []
            for _, words, found in passages(batch.column(2), keys, scores, other):
                out.append(1 / (1 + document_e(np.array([v for _, _, v in found]), words, k, lam) / chance))
                spans.append([{"start": a, "end": b, "score": v} for a, b, v in found if k * (words + 100) * math.exp(-lam * v) <= most_e])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            predicted = [int(x >= threshold) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array(predicted, pa.int32()), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    kind = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start: long, end: long, score: double>>"
    return staged(rows.mapInArrow(run, kind), "toxicity")
