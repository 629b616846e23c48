"""A trained projection and its metrics (A20, A21): mini-batch gradient descent of a linear map from predicted to target vectors.

The loss of a batch is the weighted sum of the invariance (V2) and contrastive (V5) losses of the mapped predictions. A step is one
pass over the batch's pinned rows: tasks sum their gradient and losses, sums are merged on executors, the driver keeps the map
(d x d) alone. After each epoch the map and the epoch's batch losses are written under the epoch's number, losses last; a run that
finds complete epochs goes on after them, so a lost driver costs one epoch at most.

Batches follow the MD5 of the triple, the same in every epoch; their order is shuffled by the epoch. An empty batch is left out, and
without triples there are no metrics.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.functions import rules as R
from chorus.operators import selection as SEL
from chorus.operators.ridge import fold_of
from chorus.operators.router_store import _listing

EPOCHS, BATCHES, RATE, TEAM = 5, 8, 0.02, 256
METRICS = "epoch int, batch int, n long, invariance double, contrastive double, total double"


def _gradient(weights: np.ndarray):
    w = dict(R.LOSS_WEIGHTS)

    def run(batches):
        total, sums, n = np.zeros_like(weights), np.zeros(2), 0
        for pdf in batches:
            if not len(pdf):
                continue
            p, t, x = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("z_pred", "z_target", "z_negative"))
            to, away = p @ weights.T - t + 0.0, p @ weights.T - x
            near, far = (np.sqrt(((v + R.PAIRWISE_EPS) ** 2).sum(axis=1)) for v in (to, away))
            margin = near - far + R.CONTRASTIVE_MARGIN
            pull = (to + R.PAIRWISE_EPS) / near[:, None] - (away + R.PAIRWISE_EPS) / far[:, None]
            each = w["invariance"] * 2 * to / p.shape[1] + w["contrastive"] * pull * (margin > 0)[:, None]
            total += each.T @ p
            sums += [(to * to).sum() / p.shape[1], np.maximum(0.0, margin).sum()]
            n += len(pdf)
        if n:
            yield pd.DataFrame({"team": [TaskContext.get().partitionId() // TEAM], "n": [n], "sums": [sums], "total": [total.ravel()]})
    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(pdf["n"], pdf["sums"], pdf["total"], strict=True), key=lambda r: (r[0], tuple(r[1])))
    return pd.DataFrame({"team": [0], "n": [sum(r[0] for r in rows)], "sums": [np.sum([r[1] for r in rows], axis=0)], "total": [np.sum([r[2] for r in rows], axis=0)]})


def step(rows: DataFrame, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums of both losses, summed gradient) of a batch."""
    schema = "team int, n long, sums array<double>, total array<double>"
    got = rows.mapInPandas(_gradient(weights), schema).groupBy("team").applyInPandas(_summed, schema).collect()      # a row per TEAM tasks
    got = sorted(got, key=lambda r: (r.n, tuple(r.sums)))
    return sum(r.n for r in got), np.sum([r.sums for r in got], axis=0), np.sum([r.total for r in got], axis=0).reshape(weights.shape) if got else weights * 0


def train(spark: SparkSession, triples: DataFrame, path: str, epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE) -> DataFrame:
    """The metrics table (epoch, batch, n, invariance, contrastive, total) of ``epochs`` epochs, each batch's losses before its step."""
    held = SEL.pinned(triples.select(fold_of(F.col("triple"), batches).alias("batch"), "z_pred", "z_target", "z_negative"), "triples")
    size = held.agg(F.max(F.size("z_pred"))).first()[0]
    done = 0
    while "_SUCCESS" in _listing(spark, f"{path}/metrics/epoch-{done}"):
        done += 1
    weights = np.eye(size or 1)
    if done:
        weights = np.array([r.row for r in spark.read.parquet(f"{path}/weights/epoch-{done - 1}").orderBy("i").collect()])
    w = dict(R.LOSS_WEIGHTS)
    for epoch in range(done, epochs if size else 0):
        order, rows = list(range(batches)), []
        random.Random(epoch).shuffle(order)
        for batch in order:
            n, sums, slope = step(held.where(F.col("batch") == batch), weights)
            if not n:
                continue
            invariance, contrastive = (float(v) for v in sums / n)
            rows.append((epoch, batch, n, invariance, contrastive, w["invariance"] * invariance + w["contrastive"] * contrastive))
            weights = weights - rate * slope / n
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(weights)], "i int, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights/epoch-{epoch}")
        spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics/epoch-{epoch}")
    if not size:
        return spark.createDataFrame([], METRICS)
    return spark.read.schema(METRICS).parquet(*[f"{path}/metrics/epoch-{k}" for k in range(epochs)])
