"""The pipeline over documents: quality rules, exact dedup, near duplicates, mixing, packing.

Each stage gets the documents that its predecessor kept, and all but the last return the columns of
documents. run() writes each stage to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, ngram_join, packing, quality
from quire.llm.shared import documents, removed, scratch, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of five-word shingles at a similarity of 0.8 connect, the one with the least doc_id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL can't express the language model: tests/llm holds each stage against a brute-force version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with scratch(spark) as made:  # what a stage wrote goes when the next one is written
        for name, stage in STAGES[:-1]:
            with scratch(spark) as own:
                docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
                own.keep(docs)
            removed(spark, *[path for path in made if path != docs.folder])
        with scratch(spark) as own:
            out = STAGES[-1][1](spark, docs, sf_dir)
            own.clear()  # the result reads them
    return out
