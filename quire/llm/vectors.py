"""What the operators on embeddings share: which rows take part, and sums by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame, col: str) -> DataFrame:
    """Rows whose vector is not null, has entries, and holds no null and no non-finite entry; the vector as array<double>."""
    x = F.col(col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.withColumn(col, x.cast("array<double>")).where(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))


def by_dimension(rows: DataFrame, col: str, **aggregates) -> tuple[int, list[dict]]:
    """(number of rows, aggregates of each dimension) over the rows of the commonest length, the longer one of equally common ones.

    What comes to the driver is a row for each length and dimension. aggregates see the entry as column `v`.
    """
    each = rows.select(F.size(col).alias("d"), F.posexplode(col).alias("pos", "v"))
    sums = each.groupBy("d", "pos").agg(F.count(F.lit(1)).alias("n"), *[a.alias(k) for k, a in aggregates.items()])
    top = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return 0, []
    found = sums.where(F.col("d") == top["d"]).orderBy("pos").collect()
    return top["n"], [r.asDict() for r in found]
