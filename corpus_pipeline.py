"""A corpus pipeline: quality classifier, near-dedup, substring dedup, decontamination, packing.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opslake.llm import decontamination, packing, quality_classifier, simhash, substring_dedup
from opslake.llm.common import release, remove_tables, tables_made, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(spark, docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", _quality),
    ("simhash_near_dedup", _near_dedup),
    ("substring_dedup", _substring_dedup),
    ("benchmark_decontamination", _decontaminate),
    ("best_fit_packing", _pack),
]

#: Compressed sizes, 64-bit hashes of shingles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Tables that a stage made on its way, and the documents before it, are deleted once its output is
    written; those of the last stage stay, as its result is read lazily."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        mark = tables_made()
        after = written(stage(spark, docs, sf_dir))
        release(spark, mark, after)
        if docs is not before:
            remove_tables(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
