"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A table that is read more than once, or that ends one step of an iteration, is written there as
Parquet and read again: it survives lost executors, cuts the lineage, and its file sizes let Spark
choose between a broadcast and a shuffle by measured size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_ranked(df: DataFrame, keys: list[str], order: list[Column | str], top: int, spread: list[str], buckets: int = 64) -> DataFrame:
    """``df`` with ``rank`` (from 1 per ``keys``, by ``order``), up to ``top``. Rows are ranked by bucket of ``spread`` first, so
    the last window sees at most ``buckets`` * ``top`` rows of a key, however many tasks had some."""
    bucket = F.pmod(F.xxhash64(*spread), F.lit(buckets))
    near = df.withColumn("rank_bucket", bucket)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "rank_bucket").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "rank_bucket")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
