"""Exact rows for queries that DuckDB SQL can't express, and for streams whose groups come in several chunks."""

import datetime as dt
import os
import random
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import answers, chunk, fold, metrics, processors, quote_search, quotes, report, tenancy, usage, vectors
from quire.plans.registry import queries
from quire.sources.views import doc_lines, table
from quire.streaming import queries as streams

DATA = "/root/testdata/sf0.001"


def similarity(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 0.7 * sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) + 0.3 * len(set(a) & set(b)) / max(len(set(a)), len(set(b)))  # noqa: B905


def test_quote_match_fuzzy(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 8)))
    pages = [(d, p, " ".join(word() for _ in range(rng.randint(3, 25)))) for d in range(6) for p in (1, 2, 3)]
    asked = []
    for i, (d, p, text) in enumerate(pages):
        words = text.split()[1:4]
        words[0] = words[0][:-1] + "z"
        asked.append((i, d, p if i % 2 else None, " ".join(words)))
    asked += [(99, 0, 1, ""), (98, 0, None, "zzzzzz zzzzz")]
    got = {r.quote_id: (r.start, r.score) for r in quote_search.quote_match_fuzzy(spark.createDataFrame(asked, "quote_id long, doc_id long, page_no int, text string"), spark.createDataFrame(pages, "doc_id long, page_no int, markdown string")).collect()}
    want = {}
    for i, d, p, text in asked:
        q, t = text.split(), [w for a, b, x in pages if a == d and p in (None, b) for w in x.split()]
        scores = [(round(sum(similarity(x, y) for x, y in zip(t[k : k + len(q)], q, strict=True)) / len(q), 9), -k) for k in range(len(t) - len(q) + 1)] if q else []
        if scores and max(scores)[0] >= 0.85:
            want[i] = (-max(scores)[1], round(max(scores)[0], 6))
    assert got == want and len(want) >= 12


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_scan(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        hay = "".join(rng.choice("abcd ") for _ in range(rng.randint(5, 120)))
        at = rng.randrange(len(hay))
        needle = "".join(c if rng.random() > 0.15 else "z" for c in hay[at : at + rng.randint(3, 30)])
        rows.append((i, hay, needle))
    rows += [(100, "short", "a needle that is longer"), (101, "some text of some length", "")]
    got = {r.i: r.b and (r.b.ratio, r.b.start) for r in spark.createDataFrame(rows, "i long, hay string, needle string").select("i", quote_search.fuzzy_scan(F.col("hay"), F.col("needle")).alias("b")).collect()}
    for i, hay, needle in rows:
        n = max(len(needle), 12)
        if n > len(hay) or not needle:
            assert got[i] is None
            continue
        step, best = max(5, n // 6), (0.0, 0)
        ratio = lambda k: 1 - distance(hay[k : k + n], needle) / max(len(hay[k : k + n]), len(needle))  # noqa: B023, E731
        for k in range(0, len(hay) - n + 1, step):
            if best[0] < 0.97 and ratio(k) > best[0]:
                best = ratio(k), k
        for k in range(max(0, best[1] - 2 * step), min(len(hay) - 1, best[1] + 2 * step) + 1):
            if ratio(k) > best[0]:
                best = ratio(k), k
        assert got[i] == best


def test_neighbour_pages(spark):
    """Pages beside the asked one count where they are better, or as good and earlier; pruned or not, the rows are those of all three scans."""
    rng = random.Random(9)
    pages = [(d, p, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 90)))) for d in range(25) for p in (1, 2, 3, 4)]
    pages += [(90, 1, "one and the same words"), (90, 2, "one and the same words"), (91, 1, "tiny"), (91, 2, "tiny")]
    text = {(d, p): t for d, p, t in pages}
    wanted = [(d, p, text[d, min(4, max(1, p + rng.choice((-1, 0, 1))))][3:40].replace("a", "z")) for d in range(25) for p in (1, 2, 3, 4)]
    wanted = [w for w in wanted if w[2]] + [(90, 2, "one and the same words"), (91, 1, "much longer than both pages")]
    df = spark.createDataFrame(pages, "doc_id long, page_no int, hay string")
    asked = spark.createDataFrame(wanted, "doc_id long, asked int, needle string")
    got = {(r.doc_id, r.asked): (r.page_no, r.ratio, r.start) for r in quote_search.scanned(asked, df).collect()}
    near = asked.join(df, "doc_id").where(F.abs(F.col("asked") - F.col("page_no")) <= 1)
    all_ = near.select("doc_id", "asked", "page_no", quote_search.fuzzy_scan(F.col("hay"), F.col("needle")).alias("b")).where("b is not null")
    want = {}
    for r in all_.orderBy(F.desc("b.ratio"), "page_no").collect():
        want.setdefault((r.doc_id, r.asked), (r.page_no, r.b.ratio, r.b.start))
    assert got == want and got[90, 2][0] == 1 and (91, 1) not in got
    assert near.where(quote_search.best_ratio(F.col("hay"), F.col("needle")) < F.coalesce(quote_search.fuzzy_scan(F.col("hay"), F.col("needle"))["ratio"], F.lit(0.0))).isEmpty()


def test_seeds_find_all_similar_tokens(spark):
    """Tokens that score the bound share a key, at any length; keys stay in proportion to it."""
    rng = random.Random(6)
    pairs = []
    for _ in range(4000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 40)))
        b = "".join(c if rng.random() > 0.2 else rng.choice("abcde") for c in a)
        pairs.append((a, b[: rng.randint(max(1, len(b) - 4), len(b))] if rng.random() < 0.5 else b + "a" * rng.randint(0, 5)))
    df = spark.createDataFrame(pairs, "a string, b string").where("a <> b")
    for least in (0.8, 0.7, 0.95):
        keys = quote_search.Seeds(least).keys
        far = df.where(quotes.token_similarity(F.col("a"), F.col("b")) >= least).where(~F.arrays_overlap(keys(F.col("a")), keys(F.col("b"))))
        assert far.isEmpty()
    long = spark.range(1).select(F.size(quote_search.Seeds(0.8).keys(F.repeat(F.lit("ab"), 5000))).alias("n")).first().n
    assert long <= 5000


def test_located(spark):
    """Exact before fuzzy, the page before the document, boxes in order, and a rate over all quotes."""
    lines = [(1, i, t) for i, t in enumerate(["So wrote", "Dr. P.N. Cundall, in nineteen", "and then", "", "", "Dr. P.N. Cundalt, in nineteen"])]
    df = spark.createDataFrame(lines, "doc_id long, line_no int, line string")
    from quire.operators.text import paginate

    quote = "Dr. P.N. Cundall, in"
    asked = [(1, 1, None, quote), (2, 1, 2, quote), (3, 1, 1, "nothing of the kind here"), (4, None, None, quote), (5, 7, None, quote), (6, 1, 2, ""), (7, 1, 1, "so wrote")]
    q = spark.createDataFrame(asked, "quote_id long, doc_id long, page_no int, text string")
    out = {r.quote_id: r for r in quote_search.enhanced(q, quotes.word_boxes(df), paginate(df)).collect()}
    assert {k: (r.has_bounding_boxes, r.page_no, r.kind) for k, r in out.items()} == {1: (True, 1, "exact"), 2: (True, 2, "fuzzy"), 3: (False, None, None), 4: (False, None, None), 5: (False, None, None), 6: (False, None, None), 7: (True, 1, "exact")}
    assert [w.text for w in out[2].spans] == ["Dr.", "P.N.", "Cundalt,", "in"] and [w.word_index for w in out[7].spans] == [0, 1]
    assert out[1].match_rate == round(3 / 7, 6) and 0.95 < out[2].score < 1


def test_word_spans(spark):
    """A title with initials: three words, one of which has two tokens."""
    lines = spark.createDataFrame([(1, 0, "So wrote"), (1, 1, "Dr. P.N. Cundall, in 1971"), (1, 2, "Dr. P.N. Cundall")], "doc_id long, line_no int, line string")
    docs = spark.createDataFrame([(1, "So wrote\nDr. P.N. Cundall, in 1971\nDr. P.N. Cundall")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Dr. P.N. Cundall,")], "quote_id long, text string")
    hits = quotes.quote_match_exact(docs, asked).withColumn("n", F.lit(4))
    got = quotes.word_spans(hits, quotes.word_boxes(lines), ["doc_id"]).first()
    assert [(w.page_no, w.line_index, w.word_index, w.text) for w in got.spans] == [(1, 1, 0, "Dr."), (1, 1, 1, "P.N."), (1, 1, 2, "Cundall,")]
    pages = docs.withColumn("page_no", F.lit(1)).unionByName(spark.createDataFrame([(1, "Dr. P. N. Cundall", 2)], "doc_id long, text string, page_no int"))
    assert sorted((r.page_no, r.start) for r in quotes.quote_match_exact(pages, asked).collect()) == [(1, 2), (2, 0)]


def test_vector_search(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)], i % 3) for i in range(300)] + [(300, [0.5] * 4, 1), (301, [0.5] * 4, 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, document_id int").repartition(5)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {r[0]: r[1] for r in v.select("vec_id", "embedding").collect()}
    index = vectors.VectorIndex(v)
    found = {(None, 0): index.search(q, 200), ((1,), 0): index.search(q, 200, [1]), ((1,), 1): vectors.vector_topk(v, q, 200, [1]), (None, 3): index.search(q, 3), ((7,), 0): index.search(q, 5, [7])}
    for (ids, _), rows_ in found.items():
        got = defaultdict(list)
        for r in rows_.orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert len(got) == (0 if ids == (7,) else q.count())
        for k, near in got.items():
            dist = lambda i: round(sum((x - y) ** 2 for x, y in zip(exact[i], exact[k], strict=True)), 9)  # noqa: B023, E731
            assert near == sorted((i for i in exact if ids is None or dict((r[0], r[2]) for r in rows)[i] in ids), key=lambda i: (dist(i), i))[: len(near)]
            assert len(near) == (3 if _ == 3 else 100)
    ann = vectors.vector_topk_ann(v, q, 10, 0.01)  # hardly any cells: still k rows for each
    assert ann.groupBy("query_id").count().where("count <> 10").isEmpty()
    nothing = vectors.VectorIndex(v.where("vec_id < 0"))
    assert nothing.search(q).collect() == [] and index.search(q.where("query_id < 0")).collect() == []


def test_index_reads_few_cells(spark):
    """Clustered vectors: a search's second turn reads a few of the cells, and a cell larger than a block is cut."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(10 * (i % 20 == k), 0.1) for k in range(20)], i) for i in range(3000)] + [(9000 + i, [0.0] * 20, i) for i in range(1500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, document_id int")
    index = vectors.VectorIndex(v)
    assert index.blocks.selectExpr("max(size(ids)) AS n").first().n <= vectors.ROWS and index.blocks.selectExpr("sum(size(ids)) AS n").first().n == 4500
    asked = v.where("vec_id % 50 = 0 and vec_id < 3000").selectExpr("vec_id AS query_id", "cast(embedding AS array<double>) AS embedding", "cast(1.0 AS double) AS reach")
    read = index._probes(asked, 10, 1.0).selectExpr("sum(size(query_ids)) AS n").first().n
    assert read < 0.3 * asked.count() * len(index.centres)


def test_folds_are_linear_and_ordered(spark):
    t = dt.datetime(2024, 1, 1)
    calls = [(i, i % 3, t + dt.timedelta(minutes=7 * i), i * 17 % 60) for i in range(3000)]
    random.Random(4).shuffle(calls)
    df = spark.createDataFrame(calls, "event_id long, user_id long, ts timestamp, cost long").repartition(6)
    got = {r.event_id: r.granted for r in usage.hourly_bucket(df, F.col("cost")).collect()}
    state = {}
    for i, user, at, cost in sorted(calls, key=lambda c: (c[2], c[0])):
        since, left = state.get(user, (None, 100))
        if since is None or at - since > dt.timedelta(hours=1):
            since, left = at, 100
        assert got[i] == (left >= cost)
        state[user] = since, left - cost if left >= cost else left
    big = spark.range(200_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("n"))

    def parity(state, part):
        n = state or 0
        return np.arange(n, n + len(part)) % 2 == 0, n + len(part)

    out = fold.carried(big, "k", ["n"], parity, "even", T.BooleanType())
    assert out.where(F.col("even") == (F.col("n") % 2 == 0)).count() == 200_000


@pytest.fixture
def small_chunks(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["stream_credit_bucket", "stream_quota_state", "stream_ttl"])
def test_streams_whatever_the_chunks(spark, small_chunks, tmp_path, name):
    """Rows in random order, 20 a chunk: as one pass over each user's rows in order."""
    table(spark, DATA, "events").orderBy(F.rand(7)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = table(spark, DATA, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).toPandas().sort_values(["ts", "event_id"])
    got = queries()[name](spark, str(tmp_path)).toPandas()
    if name == "stream_ttl":
        seen = rows.groupby("user_id").agg(us=("us", "max"), n=("us", "size"))
        assert {(r.user_id, r.n) for r in got.itertuples()} <= {(k, r.n) for k, r in seen.iterrows()}
        return
    got, state, want = got.set_index("event_id"), {}, {}
    prices = {p[0]: (float(p[1]), float(p[2])) for p in usage.PRICES}
    for r in rows.itertuples():
        if name == "stream_credit_bucket":
            since, left = state.get(r.user_id, (None, 100))
            if since is None or r.us - since > 3_600_000_000:
                since, left = r.us, 100
            want[r.event_id] = left >= r.event_id % 60
            state[r.user_id] = since, left - r.event_id % 60 if want[r.event_id] else left
        else:
            p = prices.get(f"model-{r.event_id % 5}", tuple(map(float, usage.DEFAULT_PRICE)))
            month, used = state.get(r.user_id, (None, 0.0))
            own = f"{r.ts:%Y-%m}"
            used = (used if own == month else 0.0) + (r.value * 1000 // 1 * p[0] + r.value * 100 // 1 * p[1]) / 1_000_000
            state[r.user_id], want[r.event_id] = (own, used), round(used, 6)
    column = "granted" if name == "stream_credit_bucket" else "used"
    assert len(got) == len(want) and all(abs(float(got.loc[k, column]) - v) < 2e-6 for k, v in want.items())


def test_stream_windows(spark):
    rows = table(spark, DATA, "events").select("event_id", "user_id", "event_type", "ts").toPandas()
    got = queries()["stream_rate_limit"](spark, DATA).toPandas()
    last = rows.ts.max() - pd.Timedelta(hours=1)
    for r in got.sample(200, random_state=1).itertuples():
        until = pd.Timestamp(r.until).tz_localize(None)
        own = rows[(rows.user_id == r.user_id) & (rows.ts < until) & (rows.ts >= until - pd.Timedelta(hours=24)) & (rows.event_type != "error")]
        assert len(own) == r.n and r.allowed == (r.n < 20) and until <= last
    unique = queries()["stream_dedup"](spark, DATA).toPandas()
    assert set(unique.message_id) == set(rows.event_id % 9000) and unique.message_id.is_unique


@pytest.mark.parametrize("name", ["stream_credit_bucket", "stream_quota_state"])
def test_streams_over_several_triggers(spark, small_chunks, tmp_path, name):
    """Files in the order of time, one a trigger: the rows of one pass."""
    rows = table(spark, DATA, "events").orderBy("ts", "event_id").toPandas()
    schema = table(spark, DATA, "events").schema
    folder = tmp_path / "events.parquet"
    for i in range(4):
        spark.createDataFrame(rows.iloc[len(rows) * i // 4 : len(rows) * (i + 1) // 4], schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        os.makedirs(folder, exist_ok=True)
        part = next(p for p in (tmp_path / f"part{i}").iterdir() if p.suffix == ".parquet")
        os.rename(part, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    source = streams.events
    try:
        streams.events = lambda spark, d: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
        got = queries()[name](spark, DATA)
    finally:
        streams.events = source
    want = queries()[name](spark, DATA)
    key = [c for c in want.columns if c != "used"]
    assert got.select(key).exceptAll(want.select(key)).isEmpty() and got.count() == want.count() > 0
    if "used" in want.columns:
        both = got.join(want.select("event_id", F.col("used").alias("w")), "event_id")
        assert both.where(F.abs(F.col("used") - F.col("w")) > 2e-9).isEmpty()


def test_late_rows_are_charged_to_their_month(spark, tmp_path):
    from quire.streaming.state import MonthlyUse

    schema = "user_id long, event_id long, ts timestamp, cost double"
    t = lambda m, day: dt.datetime(2024, m, day)
    triggers = [[(1, 1, t(1, 5), 8.0), (1, 2, t(1, 9), 3.0)], [(1, 3, t(2, 1), 1.0)], [(1, 5, t(1, 20), 4.0), (1, 4, t(1, 7), 1.0), (2, 6, t(2, 2), 20.0)]]
    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        part = next(p for p in (tmp_path / f"t{i}").iterdir() if p.suffix == ".parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(part, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drained(streams.keyed(rows, MonthlyUse(15.0), "user_id long, event_id long, month string, used double, level int"), "late")
    assert {r.event_id: (r.month, r.used, r.level) for r in out.collect()} == {1: ("2024-01", 8.0, 0), 2: ("2024-01", 11.0, 1), 3: ("2024-02", 1.0, 0), 4: ("2024-01", 12.0, 1), 5: ("2024-01", 16.0, 3), 6: ("2024-02", 20.0, 3)}


def test_state_expires_by_the_clock(spark, tmp_path):
    """A key without rows for longer than the TTL starts anew; one that has some goes on."""
    from quire.streaming.state import Recent

    source = tmp_path / "in"
    source.mkdir()

    def arrives(name: str, *users: int) -> None:
        (tmp_path / name).write_text("\n".join(f'{{"user_id": {u}}}' for u in users))
        os.rename(tmp_path / name, source / name)

    def until(*wanted: tuple) -> None:
        end = time.time() + 60
        while not set(wanted) <= set(seen) and time.time() < end:
            time.sleep(0.2)
        assert set(wanted) <= set(seen)

    name, seen = "spark.sql.streaming.stateStore.providerClass", []
    before = spark.conf.get(name, None)
    spark.conf.set(name, streams.ROCKSDB)
    rows = spark.readStream.schema("user_id long").json(str(source))
    out = streams.keyed(rows, Recent(20_000), "user_id long, n long", "ProcessingTime")
    q = out.writeStream.foreachBatch(lambda b, _: seen.extend((r.user_id, r.n) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        arrives("a.json", 1, 1, 2)
        until((1, 2), (2, 1))
        arrives("b.json", 2)
        until((2, 2))  # user 2 goes on
        time.sleep(21)
        arrives("c.json", 1)
        until((1, 1))  # user 1 starts anew
        assert (1, 3) not in seen
    finally:
        q.stop()
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_grants_by_bisection():
    rng = random.Random(12)
    for size in (1, 10, 100):
        us = np.sort(np.array([rng.randrange(200) for _ in range(400)]))
        cost = np.array([rng.choice([0, 0, 1, 2, 5, 30]) for _ in us])
        since, left, want = None, size, []
        for u, c in zip(us, cost, strict=True):
            if since is None or u - since > 40:
                since, left = u, size
            want.append(left >= c)
            left -= c if want[-1] else 0
        for cut in (0, 1, 133, 400):
            a, state = fold.grants(us[:cut], cost[:cut], None, size, 40)
            b, state = fold.grants(us[cut:], cost[cut:], state, size, 40)
            assert [*a, *b] == want and state == (since, left)


def test_a_million_calls_of_one_user(spark):
    calls = spark.range(1_000_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    began = time.time()
    n = usage.hourly_bucket(calls, F.lit(1)).where("granted").count()
    assert n == 100 * -(-1_000_000 // 1201) and time.time() - began < 60


def test_stream_schema_names(spark):
    assert streams.events(spark, DATA).isStreaming


def test_bbox_document(spark):
    got = {r.doc_id: r for r in queries()["bbox_document"](spark, DATA).collect()}
    words = defaultdict(int)
    for r in doc_lines(spark, DATA).collect():
        words[r.doc_id] += len(r.line.split())
    assert {k: r.n_words for k, r in got.items()} == {k: n for k, n in words.items() if n}
    for r in got.values():
        assert [p.page_no for p in r.pages] == sorted(p.page_no for p in r.pages) and sum(len(x.words) for p in r.pages for x in p.lines) == r.n_words


def test_sinks(spark):
    answers_ = queries()["sink_report_json"](spark, DATA).collect()
    texts = defaultdict(dict)
    for r in table(spark, DATA, "conversations").collect():
        texts[r.conv_id][r.turn] = r.text
    assert {r.conv_id: {a.turn: a.answer for a in r.answers} for r in answers_} == texts and all(r.user_id == r.conv_id % 20 for r in answers_)
    one = queries()["sink_metrics_export"](spark, DATA).collect()
    assert len(one) == 1 and one[0].value.startswith('{"files":100') and "error" not in one[0].value


def test_files_by_extension(spark):
    """Processors from bytes, HTML without one, a failing one, and files that none is for."""

    def halves(content):
        yield content[:1].decode()
        raise RuntimeError("half way")

    files_ = [(1, "a.TXT", "\n".join(map(str, range(90))).encode()), (2, "b.exe", b"x"), (3, "c.doc", None), (4, "d.html", b"<p>x</p>&amp;"), (5, "e.txt", b"\xff\xfe"), (6, "f.half", b"ab"), (7, "none", b"x"), (8, None, b"x")]
    rows = spark.createDataFrame(files_, "file_id long, name string, content binary")
    out = processors.process_files(rows, processors.PLAIN.register(".half", halves))
    got = sorted(((r.file_id, r.page_no, r.page and r.page[:3], r.error and r.error.split(":")[0]) for r in out.collect()), key=repr)
    want = [(1, 1, "0\n1", None), (1, 2, "40\n", None), (1, 3, "80\n", None), (2, 0, None, "LookupError"), (3, 1, "", None), (4, 1, "x&", None), (5, 0, None, "UnicodeDecodeError")]
    want += [(6, 0, None, "RuntimeError"), (6, 1, "a", None), (7, 0, None, "LookupError"), (8, 0, None, "LookupError")]
    assert got == sorted(want, key=repr)
    assert processors.process_files(rows.where("file_id < 0")).collect() == []


def test_quantiles_by_histograms(spark):
    """Against NumPy, with few bins and small groups so that turns go on; equal values, one value, nulls, huge and negative ones."""
    rng = random.Random(14)
    rows = [("a", rng.gauss(0, 1)) for _ in range(999)] + [("b", float(rng.randrange(3))) for _ in range(400)] + [("c", 5.0)] + [("d", None)] + [(None, float(i)) for i in range(10)]
    rows += [("e", x) for x in (-1.7e308, 1.7e308, 0.0, 3.0)] + [("f", 1e-300 * i) for i in range(50)] + [("g", 7.0)] * 60
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for q in (0.0, 0.5, 0.9, 1.0):
        for bins, most in ((4, 3), (4096, 100_000)):
            got = {r.k: r.quantile for r in metrics.quantile(df, "k", "x", q, bins, most).collect()}
            own = defaultdict(list)
            for k, x in rows:
                if x is not None:
                    own[k].append(x)
            assert got.keys() == own.keys()
            for k, xs in own.items():
                xs.sort()
                at = q * (len(xs) - 1)
                a, b = xs[int(at)], xs[int(np.ceil(at))]
                assert got[k] == pytest.approx(a + (b - a) * (at - int(at)), rel=1e-12, abs=0)


def test_running_cost_splits_a_month(spark):
    """The window's key holds the hour, so that no task has a whole month; sums are those of one pass, null users and times included."""
    rng = random.Random(15)
    t = lambda: dt.datetime(2024, rng.choice((1, 2)), rng.randint(1, 3), rng.randrange(3), rng.randrange(60))
    rows = [(i, rng.choice((1, 2, None)), t() if i % 50 else None, i / 7) for i in range(600)]
    costs = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, c double").withColumn("cost", F.col("c").cast("decimal(18,6)")).drop("c")
    from pyspark.sql import Window

    order = Window.partitionBy("user_id", "month").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = costs.withColumn("month", F.date_trunc("month", "ts").cast("date")).withColumn("used", F.sum("cost").over(order))
    got = usage.running_cost(costs).select(want.columns)
    assert got.schema == want.schema and got.count() == 600 and got.exceptAll(want).isEmpty()


def test_covering_segments():
    rng = random.Random(16)
    rows = sorted((rng.choice((0.0, 0.1, 0.5, 1.0, 1.2)) + rng.randrange(3), float(rng.randrange(5)), rng.uniform(5, 9)) for _ in range(500))
    y, lo, hi = (np.array(c) for c in zip(*rows, strict=True))
    last, want = None, []
    for a, b, c in rows:
        over = last is not None and abs(last[0] - a) <= 0.4 and min(last[2], c) - max(last[1], b) > 0.9 * (c - b)
        want.append(not over)
        last = last if over else (a, b, c)
    for cut in (0, 1, 250, 500):
        first, state = fold.covered(y[:cut], lo[:cut], hi[:cut], None, 0.4, 0.9)
        rest, state = fold.covered(y[cut:], lo[cut:], hi[cut:], state, 0.4, 0.9)
        assert [*first, *rest] == want and state == last


def test_table_answers_as_text(spark):
    cases = [('[{"a": "x<", "b": null}, 3, "t", {"b": "2"}]', "x&lt;"), ("[]", "No table data found"), ('{"a": 1}', "Invalid table data format"), ("3", "Invalid table data format"), ('[{"a": 1}] and more', "Failed"), ('[1],[2]', "Failed"), ('[1]],[[2]', "Failed"), ("1} {", "Failed"), ('1, "b": 2', "Failed"), ("", "Failed"), (None, "Failed"), ('["t"]', "No data")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = [r.h for r in df.select("i", report.render_table_text(F.col("a"), ["a", "b"]).alias("h")).orderBy("i").collect()]
    for html, (answer, part) in zip(got, cases, strict=True):
        assert part in html, answer
    assert got[0].count("<tr>") == 3 and "<td></td><td>2</td>" in got[0] and 'colspan="2"' in got[-1]
    assert "Table columns not defined" in spark.range(1).select(report.render_table_text(F.lit("[]"), []).alias("h")).first().h


def test_context_by_distance(spark):
    """Ascending distance, null last; numbered headers and footers; it ends before the first section that is too large, even if a later one would fit."""
    rows = [(1, 0.5, 1, None, 1, 2, "far"), (1, 0.1, 2, "f.pdf", None, None, "near"), (1, None, 0, "f.pdf", 3, 3, "last"), (2, 0.1, 1, "g", 1, 1, "x" * 20_000), (2, 0.2, 2, "g", 1, 1, "small")]
    df = spark.createDataFrame(rows, "doc_id long, distance double, place int, source string, start_page int, end_page int, text string")
    got = {r.doc_id: (r.sections, r.context) for r in chunk.pack_context(df, "doc_id").collect()}
    section = "=== DOCUMENT SECTION {0} ===\nSource: {1} (Pages {2})\n{3}\n=== END SECTION {0} ===\n\n".format
    assert got == {1: (3, section(1, "f.pdf", "N/A-N/A", "near") + section(2, "Document", "1-2", "far") + section(3, "f.pdf", "3-3", "last"))}


def test_replaced_documents(spark, tmp_path):
    """Other documents stay, buckets without a changed document keep their files, and a second run changes nothing."""
    path = str(tmp_path / "table")
    old = spark.range(300).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk"), F.lit("old").alias("version"))
    chunk.replace_documents(old, path)
    new = old.where("doc_id in (7, 8) and chunk = 1").withColumn("version", F.lit("new")).unionByName(old.where("doc_id < 1").withColumn("doc_id", F.lit(999).cast("long")))
    names = lambda: {os.path.join(a, f) for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    first = names()
    want = old.where("doc_id not in (7, 8)").unionByName(new)
    for _ in range(2):
        chunk.replace_documents(new, path)
        got = chunk.read_documents(spark, path, old.schema)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert len(first & names()) >= len(first) - 3
    chunk.replace_documents(new.where("doc_id < 0"), path)  # nothing to replace
    assert chunk.read_documents(spark, path, old.schema).count() == want.count()


def test_sections_of_very_many_pages(spark):
    """One document of 30,000 pages in one pass; sections are those of a plain loop."""
    pages = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("page_no"), F.repeat(F.lit("abcd"), (F.col("id") * 37 % 900).cast("int")).alias("markdown"), F.array(F.when(F.col("id") % 3 == 0, "a,").otherwise("a.")).alias("lines"))
    began = time.time()
    got = [(r.chunk, r.start_page, r.end_page, r.token_count) for r in chunk.chunk_l1(pages).select("chunk", "start_page", "end_page", "token_count").orderBy("chunk").collect()]
    assert time.time() - began < 60
    want, own, n = [], [], 0
    for i in range(30_000):
        size = i * 37 % 900
        if own and n + size > 2000:
            want.append((len(want), own[0], own[-1], n))
            own, n = [], 0
        own.append(i)
        n += size
        if n >= 1200 and i % 3:
            want.append((len(want), own[0], own[-1], n))
            own, n = [], 0
    if own:
        want.append((len(want), own[0], own[-1], n))
    assert got == want


def test_who_sees_an_agent(spark):
    visible = spark.createDataFrame([(1, "everyone", None), (2, "user", 7), (2, "organisation", 3), (3, "user", 8), (3, "organisation", 4), (4, "user", 7)], "agent_id long, audience string, audience_id long")
    member = spark.createDataFrame([(3, 7), (4, 9)], "org_id long, user_id long")
    assert {u: sorted(r.agent_id for r in tenancy.seen_by(visible, member, u).collect()) for u in (7, 8, 9, 10)} == {7: [1, 2, 4], 8: [1, 3], 9: [1, 3], 10: [1]}


def test_model_calls_are_rows(spark):
    def answer(prompt, schema):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = answers.model_map(spark.createDataFrame([(1, "a", "{}"), (2, "bad", "{}")], "id long, prompt string, schema string"), answer).orderBy("id").collect()
    assert [(r.response, r.error) for r in got] == [("A", None), (None, "no")]
