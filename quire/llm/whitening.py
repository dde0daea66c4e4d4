"""Operator 12: embedding whitening on MLlib's BlockMatrix.

Rows are numbered without gaps, centred exactly (n * x - S is a whole number, divided by n once) and dealt into
blocks of a BlockMatrix. Its transpose times itself is the scatter matrix, d x d, which the driver decomposes;
the blocks times the whitening matrix, a BlockMatrix of one block, project every row, and the projected blocks'
own scatter gives the identity error. Rows stay in the JVM: vectors go from DataFrame to matrix and back.

A product over the long side is split `middle` ways (the third form of BlockMatrix.multiply in Scala), so that
no task meets all blocks; what these tasks hand on are d x d sums. The driver holds two numbers for each block.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import scratch, staged
from quire.llm.vectors import by_dimension, finite

EXACT = "decimal(38,0)"


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with `index` from 0 without gaps, in the order of the written partitions; written once, so that numbers stay."""
    out = staged(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = {r["part"]: r["n"] for r in out.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    bases, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        bases.append(total)
        total += sizes.get(p, 0)
    base = F.get(F.lit(bases).cast("array<bigint>"), part.cast("int"))
    ranked = out.withColumn("index", base + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")
    ranked.folder = out.folder
    return ranked


def to_blocks(rows: DataFrame, n: int, d: int, block_rows: int) -> BlockMatrix:
    """rows: index, row (array<double>)."""
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    return IndexedRowMatrix(frame, n, d).toBlockMatrix(block_rows, d)


def scatter(x: BlockMatrix, middle: int) -> np.ndarray:
    """x transposed times x."""
    left = x.transpose()
    product = left._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, middle)
    return BlockMatrix(product, left.rowsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()


def to_rows(x: BlockMatrix) -> DataFrame:
    """index, row."""
    rows = callMLlibFunc("getIndexedRows", x.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("row"))


def axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest eigenvalues, their unit vectors as columns). Each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return np.maximum(values, 0.0), vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def whiten(rows: DataFrame, id_col: str, col: str, k: int = 8, block_rows: int = 4096, flat: float = 1e-12) -> DataFrame:
    """A row for each row of `rows` that takes part and each component up to k: id, component, n, deviation, whitened, explained, identity_error.

    col holds whole numbers (array<bigint>, of at most 2^53). All rows are the fit list. deviation is exact: the sum over dimensions of
    (n*x - S)^2, null where a summand is over 38 digits. Rows of other than the commonest length take no part. With fewer than k
    dimensions there are as many components as dimensions. A component whose eigenvalue is at most `flat` of the trace
    (constant dimensions, fewer rows than dimensions, a single row) has no scale: whitened is null there, and the
    identity error is that of the other components, null if there are none. Repeated rows and ids count each for
    itself, null ids included. No rows give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).alias("__id"), F.col(col).cast("array<bigint>").alias("__x"))
    n, sums = by_dimension(kept, "__x", s=F.sum(F.col("v").cast(EXACT)), most=F.max(F.abs(F.col("v").cast(EXACT))))
    d = len(sums)
    wide = n * max((int(r["most"]) for r in sums), default=0) >= 1 << 61  # n * x - S needs more than 64 bits
    with scratch(spark) as made:
        kept = numbered(kept.where(F.size("__x") == d), "fit")
        kind = EXACT if wide else "bigint"
        total = F.array(*[F.lit(str(r["s"])).cast(kind) for r in sums])
        times_n = lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)")).cast(EXACT) - s if wide else x * F.lit(n) - s
        centred = F.zip_with("__x", total, lambda x, s: times_n(x, s).cast("double") / F.lit(float(n)))
        square = lambda x, s: (lambda y: F.try_multiply(y, y).cast(EXACT))(times_n(x, s).try_cast("decimal(19,0)"))
        deviation = F.aggregate(F.zip_with("__x", total, square), F.lit(0).cast(EXACT), lambda a, y: F.try_add(a, y).try_cast(EXACT))
        if not d:
            ids = kept.select(F.col("__id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast(EXACT).alias("deviation"))
            return ids.select("*", *[F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")]).where(F.lit(False))
        middle = max(1, min(-(-n // block_rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        x = to_blocks(kept.select("index", centred.alias("row")), n, d, block_rows)
        covariance = scatter(x, middle) / n
        values, vectors = axes(covariance, k)
        trace = float(np.trace(covariance))
        sound = values > flat * trace
        scale = np.where(sound, 1 / np.sqrt(np.where(sound, values, 1.0)), 0.0)
        w = vectors * scale
        matrix = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, len(values), w.T.ravel().tolist()))], 1), d, len(values))
        white = x.multiply(matrix)
        error = None
        if sound.any():
            error = float(np.abs(scatter(white, middle)[np.ix_(sound, sound)] / n - np.eye(sound.sum())).max())
        out = staged(to_rows(white).withColumnRenamed("index", "__index"), "white")
        made.keep(out, kept)
    both = out.join(kept.hint("merge"), out["__index"] == kept["index"])
    share = F.array(*[F.lit(float(v) / trace if trace > 0 else 0.0) for v in values])
    ok = F.array(*[F.lit(bool(v)) for v in sound])
    each = both.select(F.col("__id").alias(id_col), deviation.alias("deviation"), F.posexplode("row").alias("__i", "__y"))
    return each.select(
        id_col,
        (F.col("__i") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.get(ok, F.col("__i")), F.col("__y")).alias("whitened"),
        F.get(share, F.col("__i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def embedding_components(embeddings: DataFrame, k: int = 8) -> DataFrame:
    """whiten() of embeddings (vec_id, embedding): rows whose vector is null, empty or holds null or non-finite entries are left out; entry c becomes floor(1024 * c) + 100000, with 1024 * c held within 2^53 either way."""
    rows = finite(embeddings.select("vec_id", "embedding"), "embedding")
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c * 1024, F.lit(2.0**53)), F.lit(-(2.0**53)))) + F.lit(100000))
    return whiten(rows.select("vec_id", whole.alias("x")), "vec_id", "x", k)
