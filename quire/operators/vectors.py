"""Vector search and batches of embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.plans.registry import query
from quire.session import small_batches, staged
from quire.sources.views import table

MOST = 100  # hits of a query
SAMPLE = 20_000  # vectors that cells are learnt from, at most about
CELLS = 1024  # at most: their centres go to all tasks
ROWS = 1024  # of a block
PACK = 512  # queries that meet a block at once, and rows that meet all centres, at most
BYTES = 4 << 20  # of queries in a batch, at most


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q and x."""
    return np.maximum((x * x).sum(1) - 2 * q @ x.T + (q * q).sum(1)[:, None], 0.0)


def centres(vectors: DataFrame, turns: int = 6) -> np.ndarray:
    """Centres of about the square root of as many cells as there are vectors, CELLS at most, learnt by Lloyd's turns from about SAMPLE vectors."""
    n = vectors.count()
    drawn = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
    x = drawn.select("embedding").toArrow().combine_chunks()
    if not x.num_rows:
        return np.zeros((0, 1))
    x = _matrix(x.column(0).combine_chunks() if isinstance(x.column(0), pa.ChunkedArray) else x.column(0))
    k = max(1, min(CELLS, int(np.sqrt(n)), len(x)))
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(turns):
        near = np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


class VectorIndex:
    """Vectors by the cell of their nearest centre, in blocks of ROWS at most: a written table, so that many searches share it.

    vectors: vec_id, embedding (equally long, not null), document_id. A cell's rows have distances to its centre between least and
    most; by the triangle inequality no vector of the cell is nearer to a query than what the query's own distance to the centre
    leaves. A search reads the nearest cells that hold k vectors, and then all cells that can hold a nearer one than the k-th: its rows are
    those of a full scan.
    """

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("document_id").cast("long").alias("document_id"))
        self.centres = centres(rows)
        c = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(i, PACK) for i in range(0, whole.num_rows, PACK)):
                    d = _squares(_matrix(b.column(1)), c)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1), pa.int32()), pa.array(np.sqrt(d.min(1)))], names=["vec_id", "embedding", "document_id", "cell", "away"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by cell and distance."""
            held: list[pa.RecordBatch] = []

            def full() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                away, one = t["away"].to_numpy(), lambda a, kind: pa.array([a], pa.list_(kind))
                m = _matrix(t["embedding"].combine_chunks() if isinstance(t["embedding"], pa.ChunkedArray) else t["embedding"])
                columns = [pa.array([t["cell"][0].as_py()], pa.int32()), pa.array([away.min()]), pa.array([away.max()]), one(t["vec_id"].to_pylist(), pa.int64()), one(t["document_id"].to_pylist(), pa.int64()), pa.array([m.astype("<f8").tobytes()], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["cell", "least", "most", "ids", "documents", "matrix"])

            n = 0
            for b in batches:
                cells = b.column(3).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
                for i, j in zip(cuts, cuts[1:]):  # noqa: B905
                    while i < j:
                        if held and (held[0].column(3)[0].as_py() != cells[i] or n == ROWS):
                            yield full()
                            n = 0
                        take = min(j - i, ROWS - n)
                        held.append(b.slice(i, take))
                        n, i = n + take, i + take
            if held:
                yield full()

        placed = rows.mapInArrow(assign, "vec_id long, embedding array<double>, document_id long, cell int, away double") if len(c) else rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away"))
        order = ["cell", "away", "vec_id"]
        with small_batches(self.spark):
            placed = staged(placed, "placed")
        ranged = placed.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        self.blocks = staged(ranged.mapInArrow(pack, "cell int, least double, most double, ids array<bigint>, documents array<bigint>, matrix binary"), "blocks")
        found = self.blocks.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.size("ids")).alias("n")).collect()  # CELLS rows at most
        k = max(len(c), 1)
        self.least, self.most, self.size = np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.int64)
        for r in found:
            self.least[r["cell"]], self.most[r["cell"]], self.size[r["cell"]] = r["least"], r["most"], r["n"]

    def _probes(self, queries: DataFrame, k: int, share: float | None) -> DataFrame:
        """Packs of queries for each cell that they read: cell, ids, reach, matrix. queries: query_id, embedding, reach (the k-th distance so far). share: of reach that a cell must come under; null: the nearest cells with k vectors."""
        c, least, most, size = self.centres, self.least, self.most, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, PACK):
                    b = whole.slice(at, PACK)
                    q, reach = _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
                    d = np.sqrt(_squares(q, c))
                    gap = np.maximum(np.maximum(d - most, least - d), 0.0)
                    if share is None:
                        order = np.argsort(np.where(size > 0, d, np.inf), axis=1, kind="stable")
                        before = np.cumsum(size[order], axis=1) - size[order]
                        reads = np.zeros(d.shape, bool)
                        np.put_along_axis(reads, order, before < k, axis=1)
                    else:
                        reads = gap <= share * np.sqrt(reach)[:, None] * (1 + 1e-9) + 1e-9
                    reads &= size > 0
                    ids = b.column(0).to_numpy()
                    cells = np.flatnonzero(reads.any(0))
                    some = max(1, BYTES // max(q.nbytes, 1))  # cells of a batch: each holds a copy of its queries
                    for i in range(0, len(cells), some):
                        own = cells[i : i + some]
                        lists = [np.flatnonzero(reads[:, j]) for j in own]
                        columns = [pa.array(own, pa.int32()), pa.array([ids[x] for x in lists], pa.list_(pa.int64())), pa.array([reach[x] for x in lists], pa.list_(pa.float64())), pa.array([q[x].astype("<f8").tobytes() for x in lists], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["cell", "query_ids", "reach", "queries"])

        return queries.mapInArrow(run, "cell int, query_ids array<bigint>, reach array<double>, queries binary")

    def _read(self, probes: DataFrame, k: int, document_ids: list | None) -> DataFrame:
        """query_id, vec_id, distance of the k nearest of what the probes read."""
        wanted = None if document_ids is None else np.array(document_ids, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    out: list[list] = [[], [], []]
                    ids, asked, reach = (b.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (0, 3, 4))
                    x = np.frombuffer(b.column(2)[i].as_py(), "<f8").reshape(len(ids), -1)
                    q = np.frombuffer(b.column(5)[i].as_py(), "<f8").reshape(len(asked), -1)
                    if wanted is not None:
                        keep = np.isin(np.array([-1 if v is None else v for v in b.column(1)[i].as_py()]), wanted)
                        ids, x = ids[keep], x[keep]
                    d = np.round(_squares(q, x), 9)
                    for query_id, row, most in zip(asked, d, reach, strict=True):
                        near = np.flatnonzero(row <= most)
                        near = near[np.lexsort((ids[near], row[near]))[:k]]
                        for column, v in zip(out, ([query_id] * len(near), ids[near], row[near]), strict=True):
                            column.extend(v)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "distance"])

        both = probes.join(self.blocks.hint("merge"), "cell").select("ids", "documents", "matrix", "query_ids", "reach", "queries")
        found = both.mapInArrow(run, "query_id long, vec_id long, distance double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 10, document_ids: list | None = None, share: float = 1.0) -> DataFrame:
        """query_id, vec_id, distance (squared L2, to 9 places), rank of the k nearest vectors of each query; ties by vec_id.

        queries: query_id (unique), embedding. document_ids: only vectors of these documents. k is at most MOST. With a share below 1 cells that are
        no nearer than that share of the k-th distance are left out: some of the k may be missed.
        """
        k = min(k, MOST)
        if not len(self.centres):  # no vectors
            none = [F.lit(0).cast(t).alias(c) for c, t in (("vec_id", "long"), ("distance", "double"), ("rank", "int"))]
            return queries.where(F.lit(False)).select("query_id", *none)
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float("inf")).alias("reach"))
        first = self._read(self._probes(asked, k, None), k, document_ids).where(F.col("rank") == k)
        with small_batches(self.spark):  # a row of a block or probe has up to a megabyte
            first = staged(first.select("query_id", F.col("distance").alias("known")), "reach")
        asked = asked.join(first.hint("merge"), "query_id", "left").select("query_id", "embedding", F.coalesce("known", "reach").alias("reach"))
        with small_batches(self.spark):
            return staged(self._read(self._probes(asked, k, share), k, document_ids), "nearest")  # k rows a query


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, document_ids: list | None = None) -> DataFrame:
    """query_id, vec_id, distance (squared L2, to 9 places), rank of the k nearest vectors of each query; ties by vec_id.

    k is at most MOST. document_ids: only vectors of these documents (vectors has document_id then); others aren't indexed.
    """
    if document_ids is not None:
        vectors = vectors.where(F.col("document_id").isin(document_ids))
    if "document_id" not in vectors.columns:
        vectors = vectors.withColumn("document_id", F.lit(None).cast("long"))
    return VectorIndex(vectors).search(queries, k)


def hash_embedder(texts: list[str], dims: int = 8) -> list[list[float]]:
    """A stand-in for a model: numbers from a hash, the same for the same text."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dims]] for t in texts]


def embed_batches(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hash_embedder, size: int = 100) -> DataFrame:
    """id, embedding, error: embed called on batches of at most size texts; a failed batch gives its error, all others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                own = b.slice(i, size)
                error, made = None, None
                try:
                    made = embed([t or "" for t in own.column(1).to_pylist()])
                    if len(made) != own.num_rows:
                        raise ValueError(f"{len(made)} embeddings for {own.num_rows} texts")
                except Exception as e:  # a caller's function may fail in any way
                    made, error = [None] * own.num_rows, str(e)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(made, pa.list_(pa.float64())), pa.array([error] * own.num_rows, pa.string())], names=["id", "embedding", "error"])

    return rows.mapInArrow(run, "id long, embedding array<double>, error string")


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _queries(spark, d):
    return _vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_DIST = "round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: power(CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2))), 9)"
_TOP = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_DIST} AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0))"
_FILTERED = _TOP.replace("q.vec_id % 50 = 0", "q.vec_id % 50 = 0 AND v.label IN (1, 3, 5)")


@query("vector_topk", f"SELECT 'all' AS searched, query_id, vec_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM {_TOP} WHERE rank <= 10 UNION ALL SELECT 'some', query_id, vec_id, round(distance, 6), rank::INTEGER FROM {_FILTERED} WHERE rank <= 100")
def q_vector_topk(spark, d):
    """The ten nearest vectors, and the hundred nearest (of 200 asked for) of three documents."""
    index = VectorIndex(_vectors(spark, d).withColumn("document_id", F.col("label")))
    whole = index.search(_queries(spark, d)).withColumn("searched", F.lit("all"))
    some = index.search(_queries(spark, d), 200, [1, 3, 5]).withColumn("searched", F.lit("some"))
    return whole.unionByName(some).withColumn("distance", F.round("distance", 6))


@query("gather_question_chunks", f"SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS chunks FROM {_TOP} WHERE rank <= 10 GROUP BY 1 UNION ALL SELECT DISTINCT -1 - label, '' FROM embeddings")
def gather_question_chunks(spark, d):
    """The nearest chunks of each question; questions without hits stay (here one for each label, asked without a vector)."""
    hits = vector_topk(_vectors(spark, d), _queries(spark, d))
    asked = _queries(spark, d).select("query_id").unionByName(_vectors(spark, d).select((-1 - F.col("label")).cast("long").alias("query_id")).distinct())
    own = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l"))  # k a question
    return asked.join(own.hint("merge"), "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["vec_id"].cast("string")), ","), F.lit("")).alias("chunks"))


@query("document_context", f"SELECT label AS document_id, count(*) AS chunk_count, string_agg(DISTINCT CAST(vec_id % 10 AS VARCHAR), ',' ORDER BY CAST(vec_id % 10 AS VARCHAR)) AS pages FROM {_TOP} WHERE rank <= 10 GROUP BY 1")
def document_context(spark, d):
    hits = vector_topk(_vectors(spark, d), _queries(spark, d)).hint("merge").join(_vectors(spark, d).select("vec_id", "label"), "vec_id")
    return hits.groupBy(F.col("label").alias("document_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.array_join(F.array_sort(F.collect_set((F.col("vec_id") % 10).cast("string"))), ",").alias("pages"))


@query("embed_batches")
def q_embed_batches(spark, d):
    return embed_batches(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("udf_embedder")
def udf_embedder(spark, d):
    return embed_batches(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), lambda ts: [[float(len(t))] for t in ts])


def vector_topk_ann(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.5) -> DataFrame:
    """As vector_topk, but cells that are no nearer than `share` of the k-th distance found in the nearest cells are left out.

    A query with fewer than k candidates reads all cells, as its k-th distance is infinite.
    """
    if "document_id" not in vectors.columns:
        vectors = vectors.withColumn("document_id", F.lit(None).cast("long"))
    return VectorIndex(vectors).search(queries, k, share=share)


@query("vector_topk_ann")
def q_vector_topk_ann(spark, d):
    """Recall against vector_topk over all queries is measured in the tests."""
    return vector_topk_ann(_vectors(spark, d), _queries(spark, d))
