"""Operator 7: quality rules with n-gram perplexity.

A modified Kneser-Ney model of order 5 over bytes for each language: tasks count the 5-grams of whole texts,
Spark sums them and derives continuation counts, discounts and back-off weights of all orders by joins.
Each order is stored in the shared folder as sorted arrays of keys beside log-probabilities; tasks map these
files. A key is a 23-bit hash of the language before the bytes of the gram, so languages share no counts
(two whose hashes collide would share a model). A text is scored by its mean log-probability a byte.

Bytes see neither made-up words of usual syllables nor marks put after each word, so a second perplexity,
a word, has a band of its own. Words are keyed by a 63-bit hash of their bytes and the half of the corpus that
they stand in; a text is scored by the counts of the other half, so that it doesn't make its own words
likely. Halves follow a hash of the text: equal texts are in one.

Bands are set per language: `fence` interquartile ranges below the first and above the third quartile of
log-perplexity, counted in bins of 1/4096, so that reruns agree; texts outside are rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bytetext import U, mix64, prefix_hash, span_hash, texts, words
from quire.llm.shared import handing_back, new_folder, scratch, sent, staged

ORDER, LANG_BITS = 5, 23
SHARD_ROWS = 400_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _cut(key, k: int, order: int = ORDER):
    """Keys of `order` bytes to those of their last k bytes, the language kept. key: an array or a Column."""
    if isinstance(key, Column):
        return F.shiftleft(F.shiftright(key, 8 * order), 8 * k).bitwiseOR(key.bitwiseAND(F.lit((1 << (8 * k)) - 1)))
    return (key >> (8 * order)) << (8 * k) | key & ((1 << (8 * k)) - 1)


def _grams(data: np.ndarray, off: np.ndarray, k: int, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all k-grams that lie in one text, and their starts. lang: a hash for each text."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.repeat(lang, np.diff(off))[:n]
    for j in range(k):
        key <<= 8
        key |= data[j : n + j]
    inside = np.ones(n, bool)
    for j in range(1, k):
        ends = off[1:-1] - j
        inside[ends[(ends >= 0) & (ends < n)]] = False
    at = np.flatnonzero(inside)
    return key[at], at


def _counted(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """(key, n) over all that keys() gives for the batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counts, size = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            k, back = np.unique(np.concatenate(made), return_inverse=True)
            return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for key in keys(batch):
                k, n = np.unique(key, return_counts=True)
                made.append(k)
                counts.append(n)
                size += len(k)
                if size > 700_000:
                    k, n = summed()
                    made, counts, size = [k], [n], len(k)
                    if size > 400_000:  # hand over what would not stay small
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
                        made, counts, size = [], [], 0
        if made:
            k, n = summed()
            for i in range(0, len(k), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], names=["key", "n"])

    return rows.mapInArrow(handing_back(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lang() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("lang"), F.col("lang").cast("string")), 64 - LANG_BITS)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n) over all texts."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        lang = batch.column(1).to_numpy()
        for i, data, off in texts(batch.column(0)):
            yield _grams(data, off, order, lang[i : i + len(off) - 1])[0]

    return staged(_counted(docs.select("text", _lang().alias("lang")), keys), "grams")


def _half() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("long")


def _word_keys(data: np.ndarray, off: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words in their texts' halves (the last bit), and the number of words before each text."""
    starts, ends, at = words(data, off)
    key = span_hash(prefix_hash(data), starts, ends) & ~U(1) | np.repeat(half, np.diff(at)).astype(np.uint64)
    return key.view(np.int64), at


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n) over the words of all texts."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        half = batch.column(1).to_numpy()
        for i, data, off in texts(batch.column(0)):
            yield _word_keys(data, off, half[i : i + len(off) - 1])[0]

    return staged(_counted(docs.select("text", _half().alias("half")), keys), "words")


def word_model(counts: DataFrame) -> tuple[DataFrame, list[float]]:
    """(key, p, back) with discounted counts of each half, and log2 of a new word's share in each (NaN where a half has no words)."""
    half = F.col("key").bitwiseAND(F.lit(1)).alias("half")
    size = counts.select(F.shiftright("key", 1).alias("w")).distinct().count()
    n = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)]
    sums = _discounts(counts, half, more=[F.sum("n").alias("total"), F.count(F.lit(1)).alias("words"), *n]).collect()  # a row for each half
    p, new = F.lit(None).cast("double"), [float("nan")] * 2
    for row in sums:
        disc = F.element_at(F.array(*map(F.lit, row["disc"])), F.least("n", F.lit(3)).cast("int"))
        d1, d2, d3 = row["disc"]
        rest = (d1 * row["n1"] + d2 * row["n2"] + d3 * (row["words"] - row["n1"] - row["n2"])) / row["total"] / size
        new[row["half"]] = float(np.log2(rest))
        p = F.when(F.col("key").bitwiseAND(F.lit(1)) == row["half"], (F.col("n") - disc) / row["total"] + rest).otherwise(p)
    return counts.select("key", p.alias("p"), F.lit(None).cast("double").alias("back")), new


def _discounts(counts: DataFrame, *by: Column, more: tuple | list = ()) -> DataFrame:
    """disc: the three discounts of modified Kneser-Ney, from the counts of counts; and more aggregates."""
    n = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
    y = F.when(n[0] > 0, n[0] / (n[0] + 2 * n[1])).otherwise(0.5)
    of = lambda i: F.when(n[i - 1] > 0, i - (i + 1) * y * n[i] / n[i - 1]).otherwise(0.5 * i)
    return counts.groupBy(*by).agg(F.array(*[F.least(F.greatest(of(i), F.lit(0.05)), F.lit(i - 0.05)) for i in (1, 2, 3)]).alias("disc"), *more)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For each order from 0: (key, p, back): interpolated probability (null where the key is a context only), and its weight as a context (null if it never is one).

    Order 0 has a row for each language: every byte is as likely as any other.
    """
    levels = [counts]
    for k in range(order - 1, 0, -1):  # continuation counts: distinct bytes before the shorter gram
        levels.append(staged(levels[-1].groupBy(_cut(F.col("key"), k, k + 1).alias("key")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}"))
    levels.reverse()
    out = [staged(levels[0].select(F.shiftright("key", 8).alias("key"), F.lit(1 / 256).alias("p")).distinct(), "probabilities-0")]
    for k, level in enumerate(levels, 1):
        lang = F.shiftright("key", 8 * k).alias("lang")
        discounts = sent(staged(_discounts(level, lang), f"discounts-{k}"), 10_000)  # a row a language
        disc = F.element_at("disc", F.least("n", F.lit(3)).cast("int"))
        parted = level.withColumns({"lang": lang, "ctx": F.shiftright("key", 8), "short": _cut(F.col("key"), k - 1, k)}).join(discounts, "lang")
        ctx = parted.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(disc).alias("held"))
        ctx = staged(ctx.select("ctx", "total", (F.col("held") / F.col("total")).alias("gamma")), f"contexts-{k}")
        out[-1] = out[-1].join(ctx.select(F.col("ctx").alias("key"), F.col("gamma").alias("back")).hint("merge"), "key", "full")  # what starts a text may be a context only
        lower = out[-1].select(F.col("key").alias("short"), F.col("p").alias("q"))
        parted = parted.join(lower.hint("merge"), "short")
        level = parted.join(ctx.hint("merge"), "ctx").select("key", ((F.col("n") - disc) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
        out.append(staged(level, f"probabilities-{k}"))
    out[-1] = out[-1].withColumn("back", F.lit(None).cast("double"))
    return out


def store(levels: list[DataFrame], folder: str) -> list[list[tuple[int, str, int]]]:
    """Write each order as sorted arrays; a list of (first key, file, rows) for each. Its length follows the model's size in shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # one shard, SHARD_ROWS or so
        if got is None or not got.num_rows:
            return
        key, p, back = (got.column(i).to_numpy() for i in range(3))
        file = f"{folder}/{uuid.uuid4().hex}.bin"
        fs, where = pafs.FileSystem.from_uri(file)
        fs.create_dir(where.rpartition("/")[0])
        with fs.open_output_stream(where) as f:
            f.write(key.astype("<i8").tobytes())
            f.write(np.log2(p.astype(float)).astype("<f4").tobytes())
            f.write(np.log2(np.where(np.isnan(back.astype(float)), 1.0, back.astype(float))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([int(key[0])]), pa.array([file]), pa.array([len(key)], pa.int64())], names=["first", "file", "n"])

    out = []
    for level in levels:
        n = level.count()
        sorted_rows = level.select("key", "p", "back").repartitionByRange(1 + n // SHARD_ROWS, "key").sortWithinPartitions("key")
        rows = staged(sorted_rows.mapInArrow(handing_back(run), "first long, file string, n long"), "model-files")
        out.append(sorted((r["first"], r["file"], r["n"]) for r in rows.collect()))
    return out


class Model:
    """The stored arrays, mapped where the file system is local."""

    def __init__(self, files: list[list[tuple[int, str, int]]]):
        self.levels = []
        for shards in files:
            arrays = []
            for _, file, n in shards:
                fs, where = pafs.FileSystem.from_uri(file)
                raw = np.memmap(where, np.uint8, "r") if isinstance(fs, pafs.LocalFileSystem) else np.frombuffer(fs.open_input_stream(where).read(), np.uint8)
                arrays.append((raw[: 8 * n].view("<i8"), raw[8 * n : 12 * n].view("<f4"), raw[12 * n :].view("<f4")))
            self.levels.append((np.array([s[0] for s in shards], np.int64), arrays))

    def _find(self, level: int, keys: np.ndarray, what: int) -> np.ndarray:
        """Values for keys in ascending order; NaN where absent."""
        firsts, arrays = self.levels[level]
        out = np.full(len(keys), np.nan, np.float32)
        cuts = [*np.searchsorted(keys, firsts).tolist(), len(keys)]
        for a, b, arr in zip(cuts[:-1], cuts[1:], arrays, strict=True):
            if b > a:
                at = np.minimum(np.searchsorted(arr[0], keys[a:b]), len(arr[0]) - 1)
                out[a:b] = np.where(arr[0][at] == keys[a:b], arr[what][at], np.nan)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct ascending keys, by the first order alone; NaN where absent."""
        return self._find(0, keys, 1) if len(self.levels[0][0]) else np.full(len(keys), np.nan, np.float32)

    def log2p(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct ascending keys of the highest order: by the longest gram that the model has."""
        order = len(self.levels) - 1
        out, todo, weight = np.zeros(len(keys), np.float32), np.arange(len(keys)), np.zeros(len(keys), np.float32)
        for k in range(order, -1, -1):
            cut = _cut(keys[todo], k, order)
            uniq, back = np.unique(cut, return_inverse=True)
            got = self._find(k, uniq, 1)[back]
            hit = ~np.isnan(got)
            out[todo[hit]] = got[hit] + weight[todo[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k:
                uniq, back = np.unique(cut[~hit] >> 8, return_inverse=True)
                gamma = self._find(k - 1, uniq, 2)[back]
                weight[todo] += np.where(np.isnan(gamma), 0, gamma)
        out[todo] = -8  # a language without a model
        return out


_models: dict = {}


def _rules(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, at = words(data, off)
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    chars = upto((data & 0xC0) != 0x80)
    word_chars = upto(chars[ends] - chars[starts])
    symbols = upto(_SYMBOL[data])
    owner = np.repeat(np.arange(n), np.diff(at))
    repeat = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 2:
        h = span_hash(prefix_hash(data), starts, ends)
        tri = mix64(h[:-2] * U(3) + mix64(h[1:-1] * U(5) + mix64(h[2:] * U(7) + owner[2:].astype(np.uint64))))
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        _, back, count = np.unique(tri[whole], return_inverse=True, return_counts=True)
        more = whole[count[back] > 1]
        for j in range(3):
            repeat[more + j] = 1
    lines = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        own = raw[off[i] : off[i + 1]].split(b"\n")
        if len(own) > 1:
            own = [x for x in own if x and not x.isspace()]
            lines[i] = len(own) - len(set(own))
    return [np.diff(at), np.diff(word_chars[at]), np.diff(symbols[off]), lines, np.diff(upto(repeat[:-1])[at])]


_SCORED = "doc_id long, lang string, row_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double, log_ppl_word double"


def scored(docs: DataFrame, order: int = ORDER, carry: bool = False) -> DataFrame:
    """The rules' counts, log_ppl (log2 of the perplexity a byte; null below `order` bytes) and log_ppl_word per row of docs.

    log_ppl_word is null where a text, or the half that it isn't in, has no words. carry: text and the struct
    own, of the other columns of docs, go along.
    """
    spark = docs.sparkSession
    with scratch(spark) as made:  # models and what they are made of go when the scores are written
        files = store(kneser_ney(count_grams(docs, order), order), new_folder(spark, "model"))
        level, new = word_model(count_words(docs))
        word_files = store([level], new_folder(spark, "words"))
        out = staged(_with_scores(docs, order, carry, files, word_files, new), "scored")
        made.keep(out)
    return out


def _with_scores(docs: DataFrame, order: int, carry: bool, files: list, word_files: list, new: list[float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if str(files) not in _models:
            _models.clear()
            _models[str(files)] = Model(files), Model(word_files)
        model, by_word = _models[str(files)]
        for batch in batches:
            lang = batch.column(4).to_numpy()
            for i, data, off in texts(batch.column(3)):
                n = len(off) - 1
                key, at = _grams(data, off, order, lang[i : i + n])
                uniq, back = np.unique(key, return_inverse=True)
                upto = np.concatenate([[0.0], np.cumsum(model.log2p(uniq)[back], dtype=np.float64)])
                cut = np.searchsorted(at, off)
                size = np.diff(cut)
                ppl = np.where(size > 0, -np.diff(upto[cut]) / np.maximum(size, 1), np.nan)
                half = batch.column(5).slice(i, n).to_numpy()
                uniq, back = np.unique((word := _word_keys(data, off, 1 - half))[0], return_inverse=True)
                got = by_word.find(uniq)[back]
                got = np.where(np.isnan(got), np.array(new)[uniq & 1][back], got)
                n_words = np.diff(word[1])
                upto = np.concatenate([[0.0], np.cumsum(np.nan_to_num(got), dtype=np.float64)])
                none = (n_words == 0) | np.isnan(np.array(new))[1 - half]
                word_ppl = np.where(none, np.nan, -np.diff(upto[word[1]]) / np.maximum(n_words, 1))
                own = batch.slice(i, n)
                out = [*own.columns[:3], *(pa.array(x, pa.int64()) for x in _rules(data, off)), pa.array(ppl, mask=size == 0), pa.array(word_ppl, mask=none)]
                yield pa.RecordBatch.from_arrays([*out, *([own.column(3), own.column(6)] if carry else [])], names=kind.names)

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text", "lang").alias("row_hash"), "text",
        _lang().alias("lang_hash"), _half().alias("half"), *([own.alias("own")] if carry else []),
    )
    kind = T.StructType.fromDDL(_SCORED)
    if carry:
        kind = T.StructType([*kind.fields, rows.schema["text"], rows.schema["own"]])
    return rows.mapInArrow(handing_back(run), kind)


def _quartiles(rows: DataFrame, columns: list[str], bins: int = 4096) -> DataFrame:
    """lang, and for each column its first and third quartile in bins of 1/bins: the same at each run.

    A log-perplexity is at most a few dozen, so the windows over bins stay small however common a language is.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.floor(F.col(c) * bins).alias("bin")) for c in columns])).alias("x")
    counts = rows.select("lang", parts).select("lang", "x.*").where("bin is not null").groupBy("lang", "what", "bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = W.partitionBy("lang", "what")
    counts = counts.withColumn("upto", F.sum("n").over(all_bins.orderBy("bin"))).withColumn("total", F.sum("n").over(all_bins))
    cut = lambda c, q: F.min(F.when((F.col("what") == c) & (F.col("upto") >= q * F.col("total")), F.col("bin"))) / bins
    return counts.groupBy("lang").agg(*[cut(c, q).alias(f"{c}_{name}") for c in columns for q, name in ((0.25, "q1"), (0.75, "q3"))])


def quality(
    docs: DataFrame, order: int = ORDER, fence: float = 6.0, min_words: int = 50, max_repeat: float = 0.5, word_fence: float = 3.0,
    broadcast_rows: int = 10_000, carry: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, lang, the rules' counts, base_failed, kept, log_ppl, log_ppl_word, low, high, low_word, high_word.

    Null text has no words. base_failed: fewer than min_words words, or more than max_repeat of them in
    repeated 3-word windows. The others are kept if log_ppl and log_ppl_word (unless null) lie in their
    language's bands, which are set by the documents of that language that pass the base rules; a null lang is
    a language of its own. Rows that repeat a doc_id are judged each for itself, equal rows alike. No rows give
    no rows. Whole texts are read; one text takes about 60 bytes of a task's memory for each of its own. Other
    columns may have any names. Bands of up to broadcast_rows languages are broadcast. carry: as in scored().
    """
    rows = scored(docs, order, carry)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    bands = _quartiles(rows.where(~F.col("base_failed")), ["log_ppl", "log_ppl_word"])
    width = lambda c: F.col(f"{c}_q3") - F.col(f"{c}_q1") + 1 / 4096  # noqa: E731  bins have a width too
    ends = []
    for c, f, name in (("log_ppl", fence, ""), ("log_ppl_word", word_fence, "_word")):
        ends += [(F.col(f"{c}_q1") - f * width(c)).alias(f"low{name}"), (F.col(f"{c}_q3") + f * width(c) + 1 / 4096).alias(f"high{name}")]
    bands = sent(staged(bands.select(F.col("lang").alias("band_of"), *ends), "bands"), broadcast_rows)
    out = rows.join(bands, F.col("lang").eqNullSafe(F.col("band_of")), "left").drop("band_of")
    usual = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    usual &= F.col("log_ppl_word").isNull() | F.col("log_ppl_word").between(F.col("low_word"), F.col("high_word"))
    return out.withColumn("kept", ~F.col("base_failed") & usual)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their own columns. A text is written once beside its score, and doesn't shuffle."""
    kept = quality(docs, carry=True).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])
