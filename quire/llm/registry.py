"""Query name to callable, and to DuckDB SQL, for the operators of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, hard_negatives, html_text, langid, mixing, ngram_join, packing, pii, quality, substring_dedup, token_files, toxicity, whitening
from quire.llm.shared import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir)).drop("ids")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), with_kept=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(documents(spark, sf_dir), labels).drop("passages")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_pii": op3_pii,
        "op4_mixing": op4_mixing,
        "op5_packing": op5_packing,
        "op6_token_files": op6_token_files,
        "op7_quality": op7_quality,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_language": op10_language,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_whitening": op12_whitening,
        "op13_html_text": op13_html_text,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
    }
