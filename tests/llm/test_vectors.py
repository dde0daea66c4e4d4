"""Operators 11 and 12 against brute force and their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from quire.llm import hard_negatives as hn
from quire.llm import whitening as wh
from quire.llm.vectors import finite

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("index", T.StringType()), T.StructField("row", T.StringType())])


def vectors(n: int, d: int = 6, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        v = [x + rng.gauss(0, 0.4) for x in centres[c]]
        s = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / s for x in v], c if rng.random() < 0.9 else rng.randrange(4), "i", "r"))
    return rows


def odd_rows() -> list[tuple]:
    """Rows that take no part, repeated ones, ties and a row without a number."""
    nan, inf = float("nan"), float("inf")
    good = vectors(400)
    same = good[17][1]
    return [
        *good,
        *[(1000 + i, same, 2, "i", "r") for i in range(130)],  # ties
        good[50],
        good[50],
        good[3],
        (None, good[8][1], 1, "i", "r"),
        (2001, None, 1, "i", "r"),
        (2002, [0.1, None, 0.3, 0.1, 0.1, 0.1], 1, "i", "r"),
        (2003, [0.1, nan, 0.3, 0.1, 0.1, 0.1], 1, "i", "r"),
        (2004, [0.1, inf, 0.3, 0.1, 0.1, 0.1], 1, "i", "r"),
        (2005, [0.1, -inf, 0.3, 0.1, 0.1, 0.1], 1, "i", "r"),
        (2006, [], 1, "i", "r"),
        (2007, [0.1, 0.2], 1, "i", "r"),
    ]


def valid(rows: list[tuple], d: int = 6) -> list[tuple]:
    return [r for r in rows if r[1] and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]


def floats(v: list[float]) -> list[float]:
    return [float(np.float32(x)) for x in v]


def brute_negatives(rows: list[tuple], every=50, n_pos=5, n_neg=3) -> list[tuple]:
    rows = [(i, [math.floor(256 * x) for x in floats(v)], label) for i, v, label, *_ in valid(rows) if label is not None]
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for k, (aid, a, alabel) in enumerate(rows):
        if aid is None or aid % every:
            continue
        scored = [(i, sum(x * y for x, y in zip(a, v, strict=True)), label) for j, (i, v, label) in enumerate(rows) if j != k]
        for pid, p, _ in sorted((s for s in scored if s[2] == alabel), key=key)[:n_pos]:
            hits = sorted((s for s in scored if s[2] != alabel and 50 * p <= 100 * s[1] <= 95 * p), key=key)[:n_neg]
            out += [(aid, pid, r, nid, p, n) for r, (nid, n, _) in enumerate(hits, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("emb") / "embeddings.parquet")
    spark.createDataFrame(odd_rows() + [(2100, [0.1] * 6, None, "i", "r")], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("block_rows", "page_blocks", "lead"), [(16, 3, 1), (2048, 256, 4), (1, 50, 2)])
def test_hard_negatives(embeddings, block_rows, page_blocks, lead):
    """Small blocks, many pages of zone maps and one block give the rows of brute force."""
    got = hn.hard_negatives(embeddings, every=25, block_rows=block_rows, page_blocks=page_blocks, lead=lead)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(odd_rows(), every=25)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_zone_maps_choose_blocks(spark):
    """Clustered vectors: an anchor's positives are read from few of the blocks."""
    rng = random.Random(1)
    rows = [(i, [rng.gauss(3 * (i % 8 == k), 0.05) for k in range(8)], i % 8, "i", "r") for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    v = finite(df, "embedding").withColumn("label", df["label"].cast("long"))
    keyed = hn.sort_keys(v, 8, list(range(8)), [-1.0] * 8, [5.0] * 8)
    block = hn.staged(hn.blocks(keyed, 50), "blocks")
    batches = hn.staged(hn.batches_of(block, 50, 5), "batches")
    pages, n = hn.zone_pages(block, 10)
    pairs = hn.positive_pairs(batches, pages, n).selectExpr("sum(size(which)) AS n").first()["n"]
    assert 32 <= pairs < 0.25 * 32 * block.count()  # of 32 anchors


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows, a = rng.integers(-300, 300, (40, 9)).astype(float), rng.integers(-300, 300, (7, 9)).astype(float)
    lower, upper = hn.bounds(a, rows.min(0)[None, :], rows.max(0)[None, :])
    s = a @ rows.T
    assert (lower[:, 0] <= s.min(1)).all() and (upper[:, 0] >= s.max(1)).all()


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**22, -1.0], [2.0**40, 0.0], [-(2.0**40), 0.0]])
    assert hn.products(a, b).tolist() == [[2**60 + 3, 2**62 - 3, hn.HIGH, hn.LOW]]
    low, high = hn.windows(np.array([7, 0, -3, 2**62 - 3]))
    assert low.tolist() == [4, 0, -1, 2**61 - 1] and high.tolist() == [6, 0, -3, 19 * (2**62 - 3) // 20]


def test_hilbert_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    place = hn.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(empty).collect() == [] and hn.mined(empty).columns == hn.hard_negatives(empty).columns
    only = spark.createDataFrame([(0, [0.5], 1, "i", "r"), (None, None, None, None, None)], SCHEMA)
    assert hn.hard_negatives(only).collect() == []
    large = [(0, [3e38, 1e38], 1, "i", "r"), (1, [3e38, 1e38], 1, "i", "r"), (2, [1.0, 1.0], 2, "i", "r")]
    assert hn.hard_negatives(spark.createDataFrame(large, SCHEMA)).collect() == []  # 1 is a positive; no window holds 2


def whitened_by_numpy(rows: list[tuple], k: int = 8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in floats(v)] for _, v, *_ in valid(rows)], dtype=object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), centred @ u[:, :k] / np.sqrt(e[:k]), e / e.sum()


@pytest.mark.parametrize("k", [3, 8])
def test_whitening(embeddings, k):
    """Against NumPy; with rows that take no part, repeated ones, ties and clashing names; fewer dimensions than k."""
    rows = [r for r in odd_rows()] + [(2100, [0.1] * 6, None, "i", "r")]
    n, deviation, want, share = whitened_by_numpy(rows, k)
    got = wh.embedding_components(embeddings, k).toPandas()
    assert len(got) == n * min(k, 6) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    by_component = got.groupby("component")
    assert np.allclose(by_component["explained"].first().to_numpy(), share[: min(k, 6)], rtol=1e-9)
    ids = [r[0] for r in valid(rows)]
    for c, part in by_component:
        sign = np.sign(part.set_index("vec_id").loc[7, "whitened"] * want[ids.index(7), c - 1])
        a = sorted(zip(part["vec_id"].fillna(-1), part["whitened"].astype(float), map(int, part["deviation"]), strict=True))
        b = sorted(zip([-1 if i is None else i for i in ids], sign * want[:, c - 1], map(int, deviation), strict=True))
        assert [(x[0], x[2]) for x in a] == [(x[0], x[2]) for x in b]
        assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-9)


def test_blocks_don_t_change_whitening(spark):
    rows = spark.createDataFrame([(r[0], [int(1000 * x) for x in r[1]]) for r in vectors(300)], "id long, x array<long>")
    one, many = (wh.whiten(rows, "id", "x", 4, block_rows=b).orderBy("id", "component").toPandas() for b in (4096, 7))
    assert np.allclose(one["whitened"], many["whitened"], atol=1e-9) and (one["deviation"] == many["deviation"]).all()


def test_flat_components(spark):
    """Constant dimensions have no scale; a single row has none at all."""
    rows = spark.createDataFrame([(i, [i % 5, 7, 7]) for i in range(20)], "id long, x array<long>")
    got = wh.whiten(rows, "id", "x").toPandas()
    assert got.loc[got.component == 1, "whitened"].notna().all() and got.loc[got.component > 1, "whitened"].isna().all()
    assert np.allclose(got.loc[got.component == 1, "explained"], 1.0) and got["identity_error"][0] < 1e-12
    one = wh.whiten(rows.limit(1), "id", "x").toPandas()
    assert len(one) == 3 and one["whitened"].isna().all() and one["identity_error"].isna().all() and (one["explained"] == 0).all()


def test_whitening_of_nothing(spark):
    out = wh.embedding_components(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert wh.embedding_components(spark.createDataFrame([(1, None, 1, "", ""), (2, [None], 1, "", "")], SCHEMA)).collect() == []


@pytest.mark.parametrize("values", [[0, 10**12, 3 * 10**12], [0, 10**18, 4 * 10**18]])
def test_deviation_is_exact_beyond_64_bits(spark, values):
    """Also where n * x - S itself needs more than 64 bits."""
    rows = spark.createDataFrame([(i, [v, v]) for i, v in enumerate(values)], "id long, x array<long>")
    got = {r["id"]: int(r["deviation"]) for r in wh.whiten(rows, "id", "x", 1).collect()}
    assert got == {i: 2 * (3 * v - sum(values)) ** 2 for i, v in enumerate(values)}


def test_huge_entries_are_held(spark):
    rows = [(i, [3e38 * (i % 2), 0.5 * i], 1, "", "") for i in range(6)]
    got = wh.embedding_components(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 12 and got["whitened"].notna().sum() >= 6 and got["identity_error"][0] < 1e-6
