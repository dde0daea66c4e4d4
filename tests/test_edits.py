"""Edit distances and bounds of windows against plain loops, and how many windows are measured."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.operators import edits, quote_search, quotes
from quire.plans.registry import queries


def columns(a, b, free=False):
    """Distances of a to each beginning of b; free: to the nearest end of it."""
    rows = np.zeros((len(b) + 1, len(a) + 1), int)
    rows[0], rows[:, 0] = range(len(a) + 1), 0 if free else range(len(b) + 1)
    for j, y in enumerate(b, 1):
        for i, x in enumerate(a, 1):
            rows[j, i] = min(rows[j, i - 1] + 1, rows[j - 1, i] + 1, rows[j - 1, i - 1] + (x != y))
    return rows[:, -1].tolist()


@pytest.mark.parametrize(("many", "long"), [(5, 200), (5, 20), (80, 90), (40, 60)])
def test_distances(many, long):
    rng = random.Random(many)
    text = lambda least: "".join(rng.choice("abcdé漢😀") for _ in range(rng.randint(least, long)))
    a, b = [text(1) for _ in range(many)], [text(0) for _ in range(many)]
    b = [y if rng.random() < 0.5 else x[3:] + y[:5] for x, y in zip(a, b, strict=True)]
    codes, at, size = edits.coded(a + b)
    pairs = codes, at[:many], size[:many], at[many:], size[many:]
    assert edits.distances(*pairs).tolist() == [columns(x, y)[-1] for x, y in zip(a, b, strict=True)]
    done = []
    for some, rows in edits.bottom_rows(*pairs):
        for lane, i in enumerate(some):
            assert rows[: len(b[i]) + 1, lane].tolist() == columns(a[i], b[i], free=True)
            done.append(i)
    assert sorted(done) == list(range(many))


def test_few_windows_are_measured(monkeypatch):
    """Of a page's 60 and more windows a sixth apart and 200 around the best, few need a distance."""
    rng, measured = random.Random(1), []
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    pages = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(20)]
    pairs = [(p, p[k : k + 300].replace("eta", "xta")) for p in pages for k in (rng.randrange(len(p) - 300),)]
    whole = quote_search.distances
    monkeypatch.setattr(quote_search, "distances", lambda codes, p, *rest: measured.append(len(p)) or whole(codes, p, *rest))
    best = quote_search.Pairs(pairs).best()
    assert all(r > 0.9 and p[s : s + 20].replace("eta", "xta")[:17] == x[:17] for (r, s), (p, x) in zip(best, pairs, strict=True))
    assert sum(measured) < 15 * len(pairs)


def test_lines_are_not_compared_one_by_one(spark):
    """Neighbouring lines go to the numpy kernel, in the order of their lengths, and keep their rows; texts that are missing or empty count."""
    plan = queries()["levenshtein_ratio"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein(" not in plan and "ArrowEvalPython" in plan
    rows = [("kitten", "sitting", 3), ("", "abc", 3), ("", "", 0), ("same", "same", 0), (None, "a", None)]
    got = spark.createDataFrame(rows, "a string, b string, n int").withColumn("d", edits.edit_distance(F.col("a"), F.col("b"))).collect()
    assert [r.d for r in got] == [r.n for r in got]


def test_similarity_of_neighbours(spark, monkeypatch):
    """Sums over documents, and over runs of tokens that end within one, are those of token_similarity."""
    monkeypatch.setattr(quotes, "TOKENS", 7)
    rng = random.Random(5)
    token = lambda: "".join(rng.choice("abcdé漢😀") for _ in range(rng.randint(1, 70)))
    rows = [(i, [t for t in (token() for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 2))]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, t array<string>")
    score = F.round(1_000_000 * quotes.token_similarity(F.col("p.a"), F.col("p.b"))).cast("long")
    pairs = df.select("doc_id", F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))).alias("p"))
    want = {r.doc_id: (r.pairs, r.millionths) for r in pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(score).alias("millionths")).collect()}
    got = {}
    for b in quotes.neighbour_millionths(iter(df.toArrow().combine_chunks().to_batches())):
        got |= {r["doc_id"]: (r["pairs"], r["millionths"]) for r in b.to_pylist()}
    assert got == want
    plan = queries()["token_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each token
