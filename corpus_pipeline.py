"""The corpus pipeline: reject by quality, reject by language, drop near duplicates, remove benchmark text, mix.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``.  Stages carry all columns of their input; all but the last return just those.
Nulls, empty tables, repeated rows and clashing names: see each operator's docstring, which holds here too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import decontaminate, langid, mixing, near_dedup, quality
from codestrata.storage import table, written

#: Some of these stages cannot be put in SQL (models, min-max hashing), so run() is tested against brute force.
ORACLE_SQL = None


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def reject_by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.clean(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", reject_by_quality),
    ("language ID", reject_by_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
