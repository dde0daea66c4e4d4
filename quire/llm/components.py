"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), any direction, repeats and loops allowed. Returns node, label: the least node it can reach.

    Each turn takes the least label of a node and its neighbours, then that label's own label, so that paths
    halve; turns go on until no label changes. Minima are formed within tasks before they shuffle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        near = staged(near, f"near-{turn}")
        low = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", F.least("label", "m").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        new = low.join(jump.hint("merge"), low["low"] == jump["__n"], "left").select("node", F.least("low", F.coalesce("__l", "low")).alias("label"), "was")
        new = staged(new, f"labels-{turn}")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
