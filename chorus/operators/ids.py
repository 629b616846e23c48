"""Stable content ids (F25): short prefixes of SHA-256, lengthened only where two different contents share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.operators import selection as SEL

LENGTHS = (8, 12, 16, 24, 32, 64)


def stable_ids(df: DataFrame, content: Column, name: str = "short_id", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``df``, pinned, with ``name``: the shortest prefix, of these lengths, of its content's SHA-256 that no other content of the
    table shares. Equal contents get equal ids, on every run and for every partitioning; a null content gets none.

    Each round counts prefixes of the rows that are still open, two hashes per prefix and task at most, and goes on with
    the colliding ones only. The last length must be 64, the whole hash."""
    if lengths[-1] != 64:
        raise ValueError("the last length must be 64")
    spread = SEL.pinned(df.withColumn("_hash", F.sha2(content, 256)), "ids")
    out = F.lit(None).cast("string")
    open_rows, done = spread.where(F.col("_hash").isNotNull()).select("_hash"), spread
    for n in lengths:
        prefix = F.substring("_hash", 1, n)
        shared = open_rows.groupBy(prefix.alias("_prefix")).agg(F.min("_hash").alias("_low"), F.max("_hash").alias("_high")).where("_low <> _high").select("_prefix")
        shared = SEL.pinned(shared, f"shared_{n}")
        if shared.isEmpty():
            out = F.coalesce(out, prefix)
            break
        taken = f"_shared_{n}"
        done = done.join(shared.withColumnRenamed("_prefix", taken), prefix == F.col(taken), "left")
        out = F.coalesce(out, F.when(F.col(taken).isNull(), prefix))
        open_rows = open_rows.join(shared, prefix == F.col("_prefix"), "left_semi")
    return done.select(*df.columns, out.alias(name))
