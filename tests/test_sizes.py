"""What queries shuffle and hold: figures that must not grow with a document's words, copies or neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import quotes, vectors
from quire.plans.registry import queries
from quire.sources.views import table

DATA = "/root/testdata/sf0.001"


def stages(spark):
    jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    all_ = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return {s.stageId(): s for s in map(all_.apply, range(all_.size()))}


def shuffled(spark, run):
    """Rows and bytes that the shuffles of run() write."""
    last = max(stages(spark), default=-1)
    run()
    own = [s for k, s in stages(spark).items() if k > last]
    return sum(s.shuffleWriteRecords() for s in own), sum(s.shuffleWriteBytes() for s in own)


@pytest.fixture(scope="module")
def n_tokens(spark):
    return table(spark, DATA, "documents").select(F.sum(F.size(quotes.normalize_tokens(F.coalesce("text", F.lit(""))))).alias("n")).first().n


@pytest.mark.parametrize("name", ["quote_match_fuzzy", "enhance_quotes"])
def test_quotes_shuffle_no_tokens(spark, n_tokens, name):
    """Pages, lines, quotes and the words of their boxes are shuffled, and not the tokens of texts: fewer rows than tokens."""
    rows, _ = shuffled(spark, lambda: queries()[name](spark, DATA).collect())
    assert rows < n_tokens / 2


@pytest.mark.parametrize(("name", "most"), [("bbox_document", 0), ("lines_from_words", 0), ("ocr_pages", 1)])
def test_words_stay_with_their_line(spark, name, most):
    plan = queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") <= most


def test_requests_without_session(spark):
    """Requests are dealt out once, by their session, and not again by a user that half of them haven't."""
    key, n = "spark.sql.autoBroadcastJoinThreshold", table(spark, DATA, "orders").count()
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows, _ = shuffled(spark, lambda: queries()["session_state"](spark, DATA).collect())
    finally:
        spark.conf.set(key, before)
    assert n <= rows < 2 * n


def test_probes_come_in_small_batches(spark):
    """Queries that read many cells: a batch of probes holds few copies of them, whatever the number of cells."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i) for i in range(6000)]
    index = vectors.VectorIndex(spark.createDataFrame(rows, "vec_id long, embedding array<float>, document_id long"))
    asked = spark.createDataFrame([(i, rows[i][1], 1e9) for i in range(600)], "query_id long, embedding array<double>, reach double").coalesce(1)
    sizes, run = [], []

    class Caught:
        def mapInArrow(self, f, schema):
            run.append(f)

    index._probes(Caught(), 10, 1.0)
    for b in run[0](iter(asked.toArrow().combine_chunks().to_batches())):
        sizes.append(b.nbytes)
    assert len(index.centres) > 50 and max(sizes) < 3 * vectors.BYTES
