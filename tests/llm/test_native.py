"""Exact dedup, personal data and mixing: edge cases and brute force."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup, mixing, pii

from .conftest import prose


@pytest.mark.parametrize("mb", [64, 0])
def test_exact_dedup(docs, rows, mb):
    got = exact_dedup.exact_dedup(docs, mb).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = sorted((r[0] is not None, r[0] or 0, max([x for x in groups[r[1] or ""] if x is not None], default=None) or -1, len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.keep_id or -1, g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_exact_dedup_keeps_rows(docs, rows, empty, broadcast_rows):
    kept = exact_dedup.kept_documents(docs, broadcast_rows=broadcast_rows)
    assert kept.columns == docs.columns
    got = [r["text"] or "" for r in kept.collect()]
    assert sorted(got) == sorted({r[1] or "" for r in rows})
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    assert all(best[r.text or ""] == (-1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.kept_documents(empty).count() == 0


def test_exact_dedup_in_slices(spark):
    """More rows than one filter of the least size holds: each slice of hashes has a filter of its own."""
    docs = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.floor(F.col("id") / 7 * 5).cast("string")).alias("text"), F.col("id").alias("doc_id"))
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs, 0).collect()))
    assert got == sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text].append(r.doc_id)
    assert {(g[0], g[1], g[2]) for g in got} == {(i, max(ids), len(ids)) for ids in groups.values() for i in ids}
    kept = {r.doc_id for r in exact_dedup.kept_documents(docs, 0, 0).collect()}
    assert kept == {max(ids) for ids in groups.values()}
    once, more = exact_dedup._both(docs, 0)
    alone = sum(len(ids) == 1 for ids in groups.values())
    assert once.count() >= 0.9 * alone and once.count() + more.count() == 9000
    plan = once.unionByName(more)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan  # each slice's filter was broadcast for its own job


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def base_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(x[2] for x in sorted(found))


def test_personal_data(spark, docs, rows, empty):
    odd = ["a@b.c_d@e.f g@h.i.j. x@@y.z", "1.2.3.4.5 1.2.3.999 01.002.3.4", "4111-1111-1111-1111-4111-1111-1111", "+1 555 123 4567 8901 2345 x", "9" * 5000, "a." * 3000 + "@b.c", "x@" + "b." * 4000 + "c", "😀 a@b.cc 😀 +49 (30) 1234567", "1 2 3 4 " * 2000, "12-34 5678-9012--3456"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = pii.personal_data(both).collect()
    assert len(got) == len(rows) + len(odd)
    want = sorted((r[0] or -1, hashlib.sha256(base_spans(r[1] or "").encode()).hexdigest()) for r in [*rows, *enumerate(odd, 1000)])
    assert sorted((g.doc_id or -1, g.base_sha256) for g in got) == want
    assert pii.personal_data(empty).count() == 0


BLANK = " \t\n\x0b\x0c\r"
MARK = lambda c: unicodedata.category(c)[0] in "PS" and c not in "@_$"


def brute_spans(texts, support=3, confidence=0.7, share=0.1, contexts=0.5):
    """Added spans of each text, by plain loops."""
    norm = lambda w: re.sub("[0-9]", "0", w.lower())
    instances, seen = [], Counter()
    for row, text in enumerate(texts):
        found = [(m.start(), m.end(), ok(m.group()), k, m.group()) for k, p, ok in BASE for m in re.finditer(p, text)]
        base = [x[:2] for x in found if x[2]]
        failed = [x[:2] for x in found if not x[2] and (x[3] != "card" or 12 <= len(re.sub("[^0-9]", "", x[4])) <= 19)]
        words = [(m.start(), m.group()) for m in re.finditer(rf"[^{BLANK}]+", text)]
        low = [norm(w) for _, w in words]
        seen.update(("", w) for w in low)
        seen.update(zip(low, low[1:], strict=False))
        for i, (at, w) in enumerate(words):
            labelled = i and words[i - 1][1][-1] in "=:" and at == words[i - 1][0] + len(words[i - 1][1]) + 1
            if not re.search("[0-9]", w) and not labelled:
                continue
            m = re.match(r"[^\W\d]+[=:]", w)
            label = m.group().lower() if m else ""
            head = len(label)
            while head < len(w) and MARK(w[head]) and w[head] != "+":
                head += 1
            head, tail = min(head, len(w) - 1), len(w)
            while tail and MARK(w[tail - 1]):
                tail -= 1
            core = w[head : max(tail, head + 1)]
            is_base, is_failed = (any(a < at + len(w) and b > at for a, b in spans) for spans in (base, failed))
            key = bool(re.fullmatch(r"[0-9A-Za-z+/_=-]{20,}", core)) and len(re.findall("[0-9]", core)) >= 6 and len(re.findall("[A-Za-z]", core)) >= 4
            seed = is_base or key
            bad = not seed and (is_failed or bool(re.fullmatch(r"\$?[0-9]{1,4}([.,][0-9]+)?", core)))
            p = [("left", "", low[i - 1])] if i else []
            p += [("left2", low[i - 2], low[i - 1])] if i > 1 else []
            p += [("right", "", low[i + 1])] if i + 1 < len(words) else []
            p += [("label", "", label)] if label else []
            instances.append((row, at + head, at + head + len(core), core.lower(), is_base, seed, bad, p))
    edges, n, spoken = defaultdict(dict), Counter(), Counter(x[3] for x in instances if not re.search("[0-9]", x[3]))
    for *_, value, _, seed, bad, patterns in instances:
        for p in patterns:
            old = edges[p].get(value, (False, False))
            edges[p][value] = (old[0] or seed, old[1] or bad)
            n[p] += not bad
    edges = {p: own for p, own in edges.items() if sum(seed or not bad for seed, bad in own.values()) >= support}
    elsewhere = {w for w, k in spoken.items() if seen["", w] > 2 * k and any(w in own for own in edges.values())}
    edges = {p: own for p, own in edges.items() if p[0] == "label" or n[p] >= contexts * seen[p[1:]]}
    edges = {p: {v: (seed, not seed and (bad or v in elsewhere)) for v, (seed, bad) in own.items()} for p, own in edges.items()}
    score, good = {}, None
    while True:
        now = {}
        for p, own in edges.items():
            s = [0.0 if bad else max(float(seed), score.get(v, 0.0)) for v, (seed, bad) in own.items()]
            high = sum(x >= confidence for x in s)
            q = math.floor(round(1000 * sum(s) / (sum(s) + sum(bad for _, bad in own.values()) + 1), 6)) / 1000
            if high >= support and high >= share * len(own) and q >= confidence:
                now[p] = q
        if now == good:
            break
        good, score = now, {}
        for p, q in good.items():
            for v, (_, bad) in edges[p].items():
                if not bad:
                    score[v] = max(score.get(v, 0), q)
    added = {(row, a, b) for row, a, b, v, base, _, bad, p in instances if not base and not bad and v not in elsewhere and set(p) & set(good)}
    return added, {" ".join(filter(None, p)) for p in good}


def test_patterns_discover_identifiers(spark):
    rng = random.Random(31)
    texts = [f"{prose(rng, 3)} mail: user{i}@example.com text after" for i in range(30)]
    texts += ["some mail: user99(at)example words", "mail: jane(at)example", "room 1234 is free", "see room 77", "", "mail:"]
    texts += [f'{prose(rng, 3)} token = "{rng.randrange(16 ** 40):040x}" {prose(rng, 2)}' for _ in range(12)] + ['a token = "s3cret" b', "token = plain", "other = plain"]
    texts += [f"{prose(rng, 2)} id=10.0.0.{i} 12 {prose(rng, 2)}" for i in range(6)] + ["id=abc7 x", "the 5 the 6 the\t7 +1 (555) 123-456 a=b c: d"]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    want, good = brute_spans(texts)
    added = {(i, *map(int, x.split(":")[1:])) for i, r in got.items() for x in r.spans.split(",") if x.startswith("id:")}
    assert added == want
    named = {texts[i][a:b] for i, a, b in added}
    assert {"user99(at)example", "jane(at)example", "s3cret", "plain", "abc7"} <= named and {"left mail:", "left2 token =", "label id="} <= set(good)
    assert got[32].n_id == got[33].n_id == 0 and all(got[i].n_email == 1 and got[i].n_id == 0 for i in range(30)) and (texts.index("other = plain"), 8, 13) in added
    far = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), broadcast_rows=0)
    assert {r.doc_id: r.spans for r in far.collect()} == {i: r.spans for i, r in got.items()}


def test_few_seeds_find_names_and_stop_words_find_nothing(spark):
    """Identifiers without digits, 30 seeds among 230; numbers after stop words, failed cards and words of prose aren't added."""
    rng = random.Random(5)
    name = lambda: "user" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    names = sorted({name() for _ in range(200)})
    texts = [f"{prose(rng, 12)} login: {x} {prose(rng, 9)}" for x in [*names, *[f"{n}@example.com" for n in names[:30]]]]
    planted = range(len(names))
    texts += [f"{prose(rng, 6)} the {rng.randrange(10**5, 10**7)} {prose(rng, 6)}" for _ in range(60)]
    texts += [f"the 4111 1111 1111 111{i} of" for i in (2, 3, 4, 5, 6, 7)] + [f"paid the {x}@example.org" for x in names[:40]]
    texts += [f"login: {w} it" for w in ("the", "with", "after", "there")] + [f'token = "{rng.randrange(16**40):040x}"###' for _ in range(9)] + ['token = "s3cret"###']
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want, good = brute_spans(texts)
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    added = {(i, *map(int, x.split(":")[1:])) for i, r in got.items() for x in r.spans.split(",") if x.startswith("id:")}
    assert added == want and "left the" not in good
    found = {texts[i][a:b] for i, a, b in added}
    assert set(names) <= found and all(x in names or re.fullmatch("[0-9a-f]{40}|s3cret", x) for x in found)
    assert all(got[i].n_id == 1 for i in planted)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    longest = max(len((r[1] or "").split()) for r in rows)
    for g in got:
        assert g.source_size == size[g.source] and abs(g.target - target[g.source]) < 1e-6 and g.taken in (0, g.size, 2 * g.size, 3 * g.size)
        taken[g.source] += g.taken
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    assert words == sum(taken.values())
    few = [x.drop("copies") for x in (mixing.mix(docs, broadcast_rows=0), mixing.mix(docs))]
    assert few[0].exceptAll(few[1]).isEmpty() and few[1].exceptAll(few[0]).isEmpty()
    assert sorted(map(str, mixing.mixed_documents(docs, broadcast_rows=0).collect())) == sorted(map(str, mixed.collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
