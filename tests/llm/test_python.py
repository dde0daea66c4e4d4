"""The operators that run Python in tasks: edge cases, brute force, exact round trips, held-out accuracy."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import langid, mixing, ngram_join, packing, quality, shared, substring_dedup, token_files, tokens, toxicity
from quire.llm.components import components

from .conftest import WORDS, prose

W = re.compile(r"[^\x20\x09-\x0D]+")
key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_tokens(library):
    rng = random.Random(5)
    parts = ["a", "Be", " ", "\n", "'s", ".", "é", "  ", "\t", "1", "中", ",", "ll", "　", "\x85", "ß", "½", "👍", "<|endoftext|>", "\r\n", "Ñ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [None, ""]
    got = dict(tokens.encoder(tokens.tokenizer_path()).column(pa.array(texts, pa.string())))
    assert all((got[i] == ids_of(library, t)).all() for i, t in enumerate(texts) if len(got[i]) == len(ids_of(library, t))) and all(len(got[i]) == len(ids_of(library, t)) for i, t in enumerate(texts))


def test_added_tokens(spark, library, tmp_path):
    rows = [(0, "a <|endoftext|> b"), (1, "no such token"), (2, "<|endoftext|>"), (3, "x<|endoftext|>\n<|endoftext|>y <|endoftext"), (4, None)]
    want = {i: ids_of(library, t).tobytes() for i, t in rows}
    assert np.frombuffer(want[0], "<u4").tolist() == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {g.doc_id: bytes(g.ids) for g in packing.pack(docs, capacity=256).collect()} == want
    files = token_files.read_files(token_files.write_files(docs, f"file://{tmp_path}/t")).collect()
    assert {g.doc_id: bytes(g.ids) for g in files} == want


def test_packing(docs, rows, empty, library):
    got = packing.pack(docs, capacity=256).collect()
    want = Counter()
    for r in rows:
        ids = ids_of(library, r[1])
        for k, (start, n) in enumerate(packing.cut(len(ids), 256)):
            want[(r[0], k, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    assert all(zlib.crc32(bytes(g.ids)) == g.ids_crc32 for g in got)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 256
    assert packing.pack(empty).count() == 0


def test_plan_is_tight():
    rng = random.Random(1)
    for capacity in (10, 64, 2048):
        counts = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(3000))
        placed, bins = packing.plan(counts, capacity)
        fill = Counter()
        done = Counter()
        for length, first, n, at, per, offset in placed:
            assert first == done[length]
            done[length] += n
            for i in range(n):
                fill[at + i // per] += length
        assert done == counts and max(fill.values()) <= capacity and len(fill) == bins
        total = sum(k * n for k, n in counts.items())
        assert bins <= 1.02 * max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity)) + 1


def test_token_files(spark, docs, rows, empty, library, tmp_path):
    index = token_files.write_files(docs, f"file://{tmp_path}/t", seq_len=64, batch_rows=8)
    got = sorted(token_files.read_files(index).collect(), key=lambda r: r.start)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    start = 0
    for g, r in zip(got, sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2])), strict=True):
        ids = ids_of(library, r[1])
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(ids), zlib.crc32(ids.tobytes())) and bytes(g.ids) == ids.tobytes()
        start += len(ids)
    file = index.select("file").first()[0]
    shard = token_files.ShardReader(file)
    n = index.where(F.col("file") == file).agg(F.sum("n_tokens")).first()[0]
    assert sum(shard.sequence(i)[1].true_count for i in range(-(-n // shard.seq_len))) == n and n > 3 * 64 * 8
    assert (np.concatenate([shard.sequence(i)[0] for i in range(-(-n // shard.seq_len))])[:n] == shard.ids(0, n)).all()
    assert token_files.token_files(empty).count() == 0


def test_quality(docs, rows, empty):
    got = {(g.doc_id, g.row_hash): g for g in quality.quality(docs).collect()}
    text = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", "text", F.xxhash64("text", "lang").alias("h")).collect()}
    assert set(got) == set(text)
    for k, g in got.items():
        t = text[k] or ""
        w = W.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if W.search(x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (g.base_failed and g.kept)
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in rows if any(g.kept for k, g in got.items() if k[0] == r[0] and text[k] == r[1]))
    assert quality.quality(empty).count() == 0


def brute_kneser_ney(texts, order):
    """p(gram) and back-off weights of a modified Kneser-Ney model of one language, by their definitions."""
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p, gamma = {b"": 1 / 256}, {}
    for k in range(1, order + 1):
        n = [0, *(sum(1 for c in counts[k].values() if c == i) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
        total, held = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        for c in total:
            gamma[c] = held[c] / total[c]
        for g, c in counts[k].items():
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + gamma[g[:-1]] * p[g[1:]]

    def prob(g):
        return p[g] if g in p else gamma.get(g[:-1], 1.0) * prob(g[1:])

    return prob


def test_kneser_ney(spark):
    rng = random.Random(21)
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60))), "xy"[i % 2]) for i in range(120)] + [(900, "zq", "x"), (901, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    files = quality.store(quality.kneser_ney(quality.count_grams(docs)), quality.new_folder(spark, "model"))
    model = quality.Model(files)
    hashes = {r.lang: r.h for r in docs.select("lang", quality._lang().alias("h")).distinct().collect()}
    for lang in "xy":
        prob = brute_kneser_ney([r[1].encode() for r in rows if r[2] == lang], 5)
        for text in [r[1].encode() for r in rows[:40]] + [b"unseen bytes \xff"]:
            data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
            key, at = quality._grams(data, off, 5, np.array([hashes[lang]]))
            uniq, back = np.unique(key, return_inverse=True)
            assert np.allclose(model.log2p(uniq)[back], [np.log2(prob(text[i : i + 5])) for i in at], atol=1e-4)
        for context in (b"abcd", b"ab a", b"zzzz", b"\x00\x01\x02\x03"):  # next bytes share 1
            key = np.array([(hashes[lang] << 32 | int.from_bytes(context, "big")) << 8 | b for b in range(256)])
            assert abs(np.exp2(model.log2p(key).astype(float)).sum() - 1) < 1e-4


def test_bands_are_exact_and_agree(spark):
    rng = random.Random(22)
    rows = [(i, prose(rng, 90), rng.choice(["a", "a", "b", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.quality(docs).collect()
    for lang in ("a", "b", None):
        own = [g for g in got if g.lang == lang]
        for c, fence, low, high in (("log_ppl", 6.0, "low", "high"), ("log_ppl_word", 3.0, "low_word", "high_word")):
            bins = sorted(int(g[c] * 4096 // 1) for g in own)
            q1, q3 = (bins[-(-len(bins) * q // 4) - 1] / 4096 for q in (1, 3))
            width = q3 - q1 + 1 / 4096
            assert all(abs(g[low] - (q1 - fence * width)) < 1e-9 and abs(g[high] - (q3 + fence * width + 1 / 4096)) < 1e-9 for g in own)
        assert all(g.kept == (g.low <= g.log_ppl <= g.high and g.low_word <= g.log_ppl_word <= g.high_word) for g in own)
    assert sorted(map(str, got)) == sorted(map(str, quality.quality(docs, broadcast_rows=0).collect()))


def test_perplexity_rejects_noise(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "en") for i in range(300)] + [(1000, " ".join("".join(rng.choice("qxzjkvw0987#@") for _ in range(8)) for _ in range(120)), "en")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1000] and sum(got.values()) >= 297


def test_word_perplexity_rejects_symbols_and_made_up_words(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 120), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(w + rng.choice([" ###", " $$$", ""]) for w in prose(rng, 120).split()), "en") for i in range(8)]
    parts = [w[i : i + 3] for w in WORDS for i in range(0, len(w), 3)]
    rows += [(2000 + i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(120)), "en") for i in range(8)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fence=1e9, word_fence=2.0).collect()
    assert not any(g.kept for g in got if g.doc_id >= 1000) and sum(g.kept for g in got) >= 297
    counts = quality.count_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert counts.agg(F.sum("n")).first()[0] == sum(len(W.findall(r[1])) for r in rows)
    p, new = quality.word_model(counts)
    size = counts.select(F.shiftright("key", 1)).distinct().count()
    for h in (0, 1):  # known words and new ones share 1
        row = p.where(F.col("key").bitwiseAND(F.lit(1)) == h).agg(F.sum("p"), F.count("p")).first()
        assert abs(row[0] + (size - row[1]) * 2 ** new[h] - 1) < 1e-9
    one = quality.quality(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string")).first()
    assert one.kept and one.log_ppl_word is None


def brute_removed(rows):
    """Per (doc_id, text): removed byte flags, over distinct documents in order."""
    out, seen = {}, set()
    for r in sorted(set((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = r[1].encode()
        flags = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                flags[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        out[r] = flags
    return out


def test_substring_dedup(docs, rows, empty):
    one = [r for r in rows if not (r[0] == 3 and r[1].startswith("another"))]
    part = docs.where("doc_id is null or doc_id <> 3 or not startswith(text, 'another')")
    got = substring_dedup.substring_dedup(part).collect()
    want = brute_removed(one)
    seen = Counter()
    for g in got:
        seen[(g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256)] += 1
    expected = Counter()
    for r in one:
        flags = want[(r[0], r[1] or "")]
        raw = (r[1] or "").encode()
        kept = bytes(c for c, f in zip(raw, flags, strict=True) if not f)
        expected[(r[0], len(raw), sum(flags), len([x for x in bytes(flags).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())] += 1
    assert seen == expected
    assert len(substring_dedup.substring_dedup(docs).collect()) == len(rows)  # a doc_id with two texts
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_repeats_inside_a_text(spark):
    rng = random.Random(2)
    p = prose(rng, 40)
    rows = [(1, p + " x " + p + " y " + p), (2, "z" * 500), (3, "q" + p[5:150] + "w"), (4, "é" * 120), (5, "x" * 99)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_removed(rows)
    assert {g.doc_id: g.n_removed for g in got} == {r[0]: sum(want[r]) for r in rows}


def test_a_passage_in_many_documents(spark):
    """Its first bytes follow other text in each document, so one lead has a run of its own for each."""
    rng = random.Random(14)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 12) + rng.choice([" ", " x ", " yy "]) + passage + rng.choice([" ", "."]) + prose(rng, 12)) for i in range(400)]
    want = {k[0]: sum(v) for k, v in brute_removed(rows).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_runs, broadcast_rows in ((10, 2_000_000), (10, 0), (20_000, 0)):
        got = substring_dedup.substring_dedup(docs, hot_runs=hot_runs, broadcast_rows=broadcast_rows).collect()
        assert {g.doc_id: g.n_removed for g in got} == want


def brute_components(rows, n, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for r in rows:
        w = W.findall((r[1] or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted((r[0] is not None, r[0] or 0, len(s), least.get(g, -1)) for r, s, g in zip(rows, sets, group, strict=True))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, n, percent):
    got = ngram_join.near_duplicates(docs, n, percent).collect()
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_shingles, -1 if g.component_id is None else g.component_id) for g in got) == brute_components(rows, n, percent)


def test_ngram_join_loses_no_link_in_a_cluster(spark, empty):
    rng = random.Random(4)
    base, rows = prose(rng, 150).split(), []
    for i in range(120):  # one base, with up to nine changes each: some pairs link, others don't
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((True, g.doc_id, g.n_shingles, g.component_id) for g in got) == brute_components(rows, 4, 85)
    far = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, broadcast_rows=0).collect()
    assert sorted(map(str, far)) == sorted(map(str, got))
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


@pytest.mark.parametrize(("own", "linked"), [(14, False), (3, True)])
def test_ngram_join_of_one_template(spark, own, linked, monkeypatch):
    """5,000 documents of one template of 120 words with words of their own at its end: no pair of them may be formed needlessly."""
    rng = random.Random(15)
    template = prose(rng, 120)
    rows = [(i, template + " " + " ".join(f"w{i}x{j}" for j in range(own))) for i in range(5000)]
    made, real = [], ngram_join._open_pairs

    def counted(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_open_pairs", counted)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert all(g.component_id == (0 if linked else g.doc_id) for g in got) and made == [0]


def test_open_pairs_keep_all_links(spark):
    """Against all pairs of sets whose overlap suffices, over groups in which every set has a label of its own."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(2, 45))) for _ in range(150)] + [np.arange(20), np.arange(1, 21), np.arange(40), np.arange(34)]
    for percent in (60, 80, 85, 100):
        rows = [(int(t), i, len(s), k, i) for i, s in enumerate(sets) for k, t in enumerate(s[: len(s) + percent * len(s) // -100 + 1])]
        got = {(r.a, r.b) for r in ngram_join._open_pairs(spark.createDataFrame(rows, "token long, node long, size long, pos long, label long"), percent).collect()}
        links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert links <= got


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 in ids and 60 not in ids  # a copy of text 1
    assert sorted(map(str, ngram_join.one_of_each(docs, broadcast_rows=0).collect())) == sorted(map(str, kept.collect()))


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(2))
        assert ngram_join.suffix_filter(x, y, 10**6) <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)}


def brute_segments(s):
    """Maximal segments by their recursive definition."""
    if not s:
        return []
    best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute_segments(s[:i]) + [(i, j, best[0])] + [(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]


def test_segments():
    rng = random.Random(6)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() * 0.01 for _ in range(rng.randint(0, 14))]
        got, want = toxicity.segments(np.array(s)), brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_segments_are_linear():
    for pattern in ([1.0, -2.0], [1.0, -0.5], [-1.0, 1.5, -1.0], [2.0, -1.0, -1.5]):
        s = np.array(pattern * 16_000)
        began = time.perf_counter()
        toxicity.segments(s)
        assert time.perf_counter() - began < 0.5
    descending = np.array([1e6] + [1.0, -2.0] * 16_000)  # one high lead, and then ever lower ones
    sinking = np.concatenate([[3.0 * 2000], np.tile([2.0, *[-0.2] * 12], 8000)])
    for s in (descending, sinking):
        began = time.perf_counter()
        toxicity.segments(s)
        assert time.perf_counter() - began < 1.0


def test_links_change_no_segment():
    """Against the definition's own search, one held segment after the other."""

    def plain(scores):
        out, held, total = [], [], 0.0
        for i, s in enumerate(scores.tolist()):
            before, total = total, total + s
            if s <= 0:
                continue
            new = (i, i + 1, before, total)
            while held:
                j = len(held) - 1
                while j >= 0 and held[j][2] >= new[2]:
                    j -= 1
                if j < 0 or held[j][3] >= new[3]:
                    break
                new = (held[j][0], new[1], held[j][2], new[3])
                del held[j:]
            held.append(new)
        return [(a, b, r - x) for a, b, x, r in held]

    rng = np.random.default_rng(11)
    for n in (1, 5, 60, 900):
        for _ in range(60):
            s = rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.5], n) if n % 2 else rng.normal(-0.1, 1, n)
            assert sorted(toxicity.segments(s)) == plain(s)


def test_document_e():
    k, lam = 1e-4, 0.7
    for scores, words in (([9.0], 200), ([8.0, 7.5, 7.0], 500), ([], 50), ([1.0, 0.5], 900)):
        x = sorted((lam * v - math.log(k * (words + 100)) for v in [*scores, 0.0]), reverse=True)
        want = [math.exp(-x[0])]
        for r in range(2, len(x) + 1):
            t = sum(x[:r])
            if x[r - 1] <= 0 or sum(x[: r - 1]) <= 0:
                break
            want.append(2 ** (r - 1) * math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)))
        assert math.isclose(toxicity.document_e(np.array(scores), words, k, lam), min(want), rel_tol=1e-9)


def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    bad = ["idiot", "moron", "scumbag", "trashy"]
    rows, labels = [], []
    for i in range(1200):
        words, toxic = prose(rng, rng.randint(20, 200)).split(), int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [g for g in got if zlib.crc32(str(g.doc_id).encode()) % 3 == 1]
    assert all(g.held_out for g in held) and len(held) == sum(g.held_out for g in got)
    toxic = dict(labels)
    assert sum(g.predicted == toxic[g.doc_id] for g in held) / len(held) > 0.95
    assert all(any(w in dict(rows)[g.doc_id].encode()[p.start : p.end].decode() for w in bad) for g in held if g.predicted for p in g.passages[:1])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {g.predicted for g in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0


def test_language(spark, docs, rows, empty):
    rng = random.Random(10)
    words = {"en": WORDS, "de": "der die das und nicht ist mit auf eine für auch werden aus sich noch nach über".split(), "fr": "le la les des une est dans pour que qui sur avec être plus où été".split()}
    data = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60))), lang) for i, lang in ((i, rng.choice(list(words))) for i in range(900))]
    data += [(2000, None, "en"), (2001, "123 !?", "de"), (2002, "", None)]
    got = langid.language(spark.createDataFrame(data, "doc_id long, text string, lang string"), per_lang=100).collect()
    lang = {d[0]: d[2] for d in data}
    held = [g for g in got if g.held_out and g.doc_id < 2000]
    assert held and all(zlib.crc32(str(g.doc_id).encode()) % 4 == 2 for g in held)
    assert sum(g.lang_pred == lang[g.doc_id] for g in held) / len(held) > 0.97
    assert {(g.lang_pred, g.score) for g in got if g.doc_id >= 2000} == {("und", 0.0)} and all(0 <= g.score <= 1 for g in got)
    assert langid.language(docs).count() == len(rows)
    assert {g.lang_pred for g in langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language(empty).count() == 0
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.language(spark.createDataFrame(data, "doc_id long, text string, lang string"), max_langs=2)


def test_ftrl():
    """One weight at a time, by the update's definition."""
    xs, ys = [(np.array([3]), np.array([2.0], np.float32))] * 3, np.array([0, 1, 0])
    z, g2, w = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]
    weight = lambda z, n: 0.0 if abs(z) <= 0.05 else -(z - math.copysign(0.05, z)) / ((1 + math.sqrt(n)) / 0.5 + 0.01)
    for i in np.random.default_rng(1).permutation(3):
        w = [weight(*x) for x in zip(z, g2, strict=True)]
        e = [math.exp(2 * v) for v in w]
        for c in range(2):
            g = 2 * (e[c] / sum(e) - (ys[i] == c))
            z[c] += g - (math.sqrt(g2[c] + g * g) - math.sqrt(g2[c])) / 0.5 * w[c]
            g2[c] += g * g
    got = langid.ftrl(xs, ys, 2, 1)
    assert np.allclose(got[3], [weight(*x) for x in zip(z, g2, strict=True)], atol=1e-6) and np.count_nonzero(got) <= 2


def test_pipeline(spark, rows, docs, empty, tmp_path):
    """Each stage by a brute-force version over what its predecessor kept."""
    import corpus_pipeline

    path = f"{tmp_path}/sf"
    docs.write.parquet(f"{path}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    good = stages[0](spark, docs, path)
    judged = {(g.doc_id, g.row_hash): g.kept for g in quality.quality(docs).collect()}  # held against brute force above
    hashes = docs.withColumn("h", F.xxhash64("text", "lang")).collect()
    assert plain(good) == sorted((tuple(r)[:-1] for r in hashes if judged[r.doc_id, r.h]), key=str) and good.columns == docs.columns
    some = docs.where("text is null or length(text) < 3000")  # the stages after it also by rows that it would reject
    once = stages[1](spark, some, path)
    own = [tuple(r) for r in some.collect()]
    best = {}
    for r in own:
        best[r[1] or ""] = max(best.get(r[1] or "", (False, 0)), (r[0] is not None, r[0] or 0))
    want = {r for r in own if best[r[1] or ""] == (r[0] is not None, r[0] or 0)}
    assert len(plain(once)) == len(best) and set(plain(once)) <= want and once.columns == docs.columns
    apart = stages[2](spark, once, path)
    left = plain(once)
    least = brute_components(left, 5, 80)
    keep = {(d[1] if d[0] else None) for d in least if d[3] in (-1, d[1]) or d[2] == 0}
    assert {r[0] for r in plain(apart)} == keep and set(plain(apart)) <= set(left)
    mixed = stages[3](spark, apart, path)
    taken = Counter()
    for r in mixing.mix(apart).collect():  # held against brute force in test_native
        taken[r.doc_id] += r.copies
    assert Counter(r[0] for r in plain(mixed)) == +taken and set(plain(mixed)) <= set(plain(apart))
    pieces = stages[4](spark, mixed, path).collect()
    library = Tokenizer.from_file(tokens.tokenizer_path())
    want = Counter()
    for r in mixed.collect():
        ids = ids_of(library, r.text)
        want.update((r.doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids), 2048)))
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in pieces) == want
    ids = {g.doc_id for g in corpus_pipeline.run(spark, path).collect()}
    assert ids and ids <= {r[0] for r in rows}
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_scratch_removes_its_folders(spark):
    with shared.scratch(spark):
        with shared.scratch(spark) as made:
            df, gone = shared.staged(spark.range(5), "kept"), shared.staged(spark.range(5), "gone").folder
            made.keep(df)
        assert df.count() == 5 and not os.path.exists(gone.removeprefix("file:")) and os.path.exists(df.folder.removeprefix("file:"))
    assert not os.path.exists(df.folder.removeprefix("file:"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


@pytest.mark.parametrize("filled", [0.0, 0.001, 0.3, 0.66, 0.67, 0.9, 1.0])
def test_packed_counts(filled):
    rng = np.random.default_rng(int(filled * 1000))
    part = np.where(rng.random(1 << ngram_join.CHUNK_BITS) < filled, rng.integers(1, 1 << 32, 1 << ngram_join.CHUNK_BITS), 0).astype(np.uint32)
    sums = np.full(len(part), 5, np.uint64)
    raw = ngram_join._packed(part)
    assert len(raw) <= 4 * len(part)
    ngram_join._add_packed(raw, sums)
    assert (sums == part.astype(np.uint64) + 5).all()
