"""Corpus pipeline: from raw documents to shuffled training shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet to the shared folder and read again as the next stage's documents. All
but the last return the columns of ``documents``.

1. quality: documents that the quality classifier scores below 0.7 go.
2. near_duplicates: of each group linked by 5-word Jaccard similarity of 0.8 or more, one stays.
3. decontamination: documents with a 10-word window of a benchmark item go.
4. mixing: every document stays as often as its source's target asks (0 to 3 copies).
5. sharding: uniform shuffle into 24 shards; adds ``shard`` and ``slot``.

Null texts and empty tables pass through every stage as its operator states.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chorus.llm import decontam, jaccard, mixing, quality, shards  # noqa: E402
from chorus.llm.shared import stored  # noqa: E402
from chorus.sources.tables import read_table  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.shuffled(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# Model scores and random draws have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
