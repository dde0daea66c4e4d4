"""Operator 10: language by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (letters in lower case, all else as a blank), valued by
their share of the text's n-grams times their inverse document frequency. Weights are learnt by
follow-the-regularised-leader with L1 and L2 penalties in a few shards and averaged; a part of the sample
that no shard sees sets one softmax temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytetext import U, mix64, texts
from quire.llm.shared import scratch, staged

BITS = 16
SCALE = 100.0
NONE = "und"


def _fold() -> np.ndarray:
    """Code points below U+0250 to their lower case where that is one character, 32 for what is no letter."""
    out = np.arange(0x250, dtype=np.uint32)
    for i in range(0x250):
        c = chr(i).lower()
        out[i] = ord(c) if c.isalpha() and len(c) == 1 else 32
    return out


_FOLD = _fold()


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: (features of all n-grams that lie in one text, the number of them before each text)."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    low = cp < 0x250
    cp[low] = _FOLD[cp[low]]
    cp[(cp >= 0x2000) & (cp < 0x2C00)] = 32
    cp = cp.astype(np.uint64)
    out = []
    for n in (1, 2, 3):
        m = len(cp) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(off), np.int64)))
            continue
        key = np.full(m, U(n))
        for j in range(n):
            key = key * U(0x110000) + cp[j : m + j]
        ok = np.ones(m, bool)
        for j in range(1, n):
            cut = lead[1:-1] - j
            ok[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(ok)
        out.append(((mix64(key[at]) >> U(64 - BITS)).astype(np.int64), np.searchsorted(at, lead)))
    return out


def _vectors(column: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text."""
    for _, data, off in texts(column):
        made = features(data, off)
        for j in range(len(off) - 1):
            own = np.concatenate([f[at[j] : at[j + 1]] for f, at in made])
            f, n = np.unique(own, return_counts=True)
            yield f, n / max(len(own), 1) * idf[f] * SCALE


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all 2^BITS features, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, data, off in texts(batch.column(0)):
                docs = np.arange(len(off) - 1)
                own = [np.repeat(docs, np.diff(at)) << BITS | f for f, at in features(data, off)]
                df += np.bincount(np.unique(np.concatenate(own)) & ((1 << BITS) - 1), minlength=1 << BITS)
                n += len(docs)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], names=["f", "n"])

    sums = rows.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # at most 2^BITS + 1 rows
    total = max(int(sums.n[sums.f < 0].sum()), 1)
    df = np.zeros(1 << BITS)
    df[sums.f[sums.f >= 0]] = sums.n[sums.f >= 0]
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, n_classes: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal with elastic net."""
    z, g2 = np.zeros((1 << BITS, n_classes)), np.zeros((1 << BITS, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(xs)):
            f, x = xs[i]
            zi, ni = z[f], g2[f]
            w = weights(zi, ni)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[ys[i]] -= 1
            g = np.outer(x, p)
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            g2[f] = ni + g * g
    return weights(z, g2)


def train(rows: DataFrame, idf: np.ndarray, langs: list[str], per_lang: int, shards: int, epochs: int) -> tuple[np.ndarray, float]:
    """(weights, temperature) from at most about per_lang rows a language; rows: doc_id, text, lang."""
    spark = rows.sparkSession
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = F.broadcast(staged(counts, "languages"))  # a row for each of at most max_langs
    h = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))
    picked = rows.select("doc_id", "lang").withColumn("h", h).join(counts, "lang").where(F.col("h") < F.lit(per_lang * float(1 << 30)) / F.col("n"))
    picked = staged(picked.select(F.col("doc_id").alias("__id"), F.pmod("h", F.lit(shards + 1)).alias("shard")).distinct(), "sample")
    # A sample of bounded size: its ids are broadcast, and only its texts shuffle.
    sample = staged(rows.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("text", "lang", "shard"), "sample-texts")
    n = len(langs)
    number = {x: i for i, x in enumerate(langs)}
    shared = spark.sparkContext.broadcast(idf)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        xs = list(_vectors(pa.array(own["text"], pa.string()), shared.value))
        w = ftrl(xs, own["lang"].map(number).to_numpy(), n, epochs)
        f = np.flatnonzero(np.abs(w).sum(1))
        return pd.DataFrame({"f": f, "w": list(w[f])})

    averaged = sample.where("shard > 0").groupBy("shard").applyInPandas(fit, "f long, w array<double>")
    averaged = averaged.select("f", F.posexplode("w").alias("c", "w")).groupBy("f", "c").agg((F.sum("w") / shards).alias("w")).toPandas()  # at most 2^BITS rows a language
    weights = np.zeros((1 << BITS, n), np.float32)
    weights[averaged.f, averaged.c] = averaged.w
    model = spark.sparkContext.broadcast(weights)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(x @ model.value[f]).astype(float) for f, x in _vectors(b.column(0), shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array([number[x] for x in b.column(1).to_pylist()], pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["y", "logits"])

    apart = sample.where("shard = 0").select("text", "lang").mapInArrow(logits, "y long, logits array<double>").toPandas()
    if not len(apart):
        return weights, 1.0
    lg, y = np.stack(apart.logits.to_numpy()), apart.y.to_numpy()

    def loss(t: float) -> float:
        s = lg / t
        return float(np.mean(np.logaddexp.reduce(s, 1) - s[np.arange(len(y)), y]))

    return weights, float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 241)), key=loss))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def language(docs: DataFrame, per_lang: int = 800, shards: int = 3, epochs: int = 4, max_langs: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from at most about per_lang documents a language, none of them held out and none without a lang or
    a letter; document frequencies come from all such documents. Texts that are null or have no letter are
    `und` with score 0, and so is every text if there is nothing to learn from. Rows that repeat a doc_id are
    judged each for itself; of languages that score alike the first in code point order is taken. No rows give
    no rows. Whole texts are read; a text takes about 60 bytes of a task's memory for each of its own. Other
    columns of docs are not read. The model has 2^BITS numbers a language, 64 MB for max_langs of 256; more
    distinct values of lang are an error.
    """
    with scratch(docs.sparkSession) as made:
        out = _scored(docs, per_lang, shards, epochs, max_langs)
        made.keep(out)
    return out


def _scored(docs: DataFrame, per_lang: int, shards: int, epochs: int, max_langs: int) -> DataFrame:
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    learn = rows.where("lang is not null and doc_id is not null").where(~held_out() & lettered)
    langs = sorted(r[0] for r in learn.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages to learn: the model would outgrow a broadcast")
    weights, t, idf = np.zeros((1 << BITS, 1), np.float32), 1.0, np.ones(1 << BITS, np.float32)
    if langs:
        idf = document_frequencies(learn)
        weights, t = train(learn, idf, langs, per_lang, shards, epochs)
    table = np.ascontiguousarray((weights * idf[:, None] * (SCALE / t)).T.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2^BITS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            for i, data, off in texts(batch.column(3)):
                n = len(off) - 1
                sums, size = np.zeros((len(table), n)), np.zeros(n)
                for f, at in features(data, off):
                    size += np.diff(at)
                    for c, row in enumerate(table):
                        sums[c] += np.diff(np.concatenate([[0.0], np.cumsum(row[f], dtype=np.float64)])[at])
                s = sums / np.maximum(size, 1)
                p = np.exp(s - s.max(0))
                p /= p.sum(0)
                best = p.argmax(0)
                known = lettered[i : i + n] & bool(langs)
                pred = [langs[b] if k else NONE for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                own = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(pred), pa.array(np.where(known, p.max(0), 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    out = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), lettered.alias("lettered"), "text")
    return staged(out.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"), "languages")
