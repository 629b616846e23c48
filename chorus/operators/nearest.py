"""Exact nearest vectors of a stated query set among all vectors (W8's candidates).

Queries are dealt into blocks of ``QUERIES`` and vectors into blocks of ``VECTORS``; a pair of blocks is one matrix product, from which
each query keeps its ``k`` best, so a task holds two blocks and no pair of vectors becomes a row. The kept rows of all
blocks are ranked per query in two levels: by groups of ``MERGE`` blocks first, so the last window sees k rows per group.

Scores are cosines rounded to ``DIGITS`` places; ties go to the smaller id. A query is never its own neighbour. Rows with a null id or a null or
empty vector do not take part; a zero vector has score 0 with all; vectors of another length than the query's never meet it; fewer than
k others give fewer rows. Repeated rows are separate neighbours of equal id and score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES, VECTORS, MERGE, DIGITS = 512, 4096, 64, 6


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _best(k: int, digits: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", kind="stable")
            score = np.round(_unit(asked["vector"]) @ _unit(held["vector"]).T, digits) + 0.0
            other = held["id"].to_numpy()
            for row, own in zip(score, asked["id"].to_numpy(), strict=True):
                row[other == own] = -np.inf
                first = np.argsort(-row, kind="stable")[:k]
                first = first[np.isfinite(row[first])]
                out.append(pd.DataFrame({"id": own, "other": other[first], "score": row[first], "block": held["block"].iloc[0]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "other": [], "score": [], "block": []})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``rank`` (1 to k), ``other``, ``score``: the k vectors of the highest cosine for every row that ``is_query`` marks."""
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("width"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).first()
    across, down = max(1, -(-size.n // VECTORS)), max(1, -(-size.q // QUERIES))
    held = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(across)).cast("int"))
    queries = rows.where("asked").withColumn("team", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(down)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    meet = ["width", "team", "block"]
    named = lambda df: df.select(*[F.col(c).alias(c) for c in (*meet, "id", "vector")])  # noqa: E731  columns of its own for each side
    left = named(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
    right = named(held.withColumn("team", every))
    found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(_best(k, DIGITS), "id long, other long, score double, block int")
    order = [F.desc("score"), "other"]
    near = found.withColumn("group", F.floor(F.col("block") / MERGE))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("id", "group").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k).select("id", "rank", "other", "score")
