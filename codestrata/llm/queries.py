"""Queries and SQL of the operators of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, exact_topk, langid, licenses, mixing, near_dedup, quality, token_counts, url_filter, warc
from codestrata.storage import table, written


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), queries=exact_topk.ASKED)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicates(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = written(token_counts.build(docs), "trees", compression="zstd")
    return token_counts.recount(trees, token_counts.example_edits(F.col("text"), F.col("doc_id")))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(warc.captures(table(spark, sf_dir, "pages")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in (op1_decontaminate, op2_exact_topk, op3_quality, op4_licenses, op5_near_dedup, op6_mix, op7_token_counts, op8_warc_revisits, op9_url_filter, op10_language)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op6_mix": mixing.SQL, "op2_exact_topk": exact_topk.SQL, "op8_warc_revisits": warc.SQL, "op9_url_filter": url_filter.SQL}
