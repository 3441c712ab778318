"""From raw documents to packed training sequences; each stage takes what the one before kept.

quality: documents that the classifier rejects go. near_dedup: of each group of near copies (5-word
shingles, similarity 0.8) the smallest id stays. decontaminate: documents that hold a benchmark item
go. secrets: spans are replaced by a mark, no document goes. packing: token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, near_dedup, packing, quality, secrets
from gridloom.llm.common import scratch
from gridloom.llm.queries import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The classifier's and the tokenizer's results can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
