"""Embedding-space quality measures (V1-V7, W8) on ``ArrayType(Float)`` columns.

Per-row measures (cosine, distances) are array expressions. Cross-row measures (per-dimension std, covariance)
come from centred moments that each task computes with numpy and that are merged pairwise: rows x d^2 flops, but never
rows x d or rows x d^2 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions import rules as R


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dsum(arr) -> Column:
    """Left-to-right double sum of an array."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _dsum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_dsum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b, eps: float = R.COSINE_EPS) -> Column:
    """V1: a.b / (max(|a|, eps) * max(|b|, eps))."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def pairwise_distance(a, b, eps: float = R.PAIRWISE_EPS) -> Column:
    """Euclidean distance with eps added to every difference (torch's pairwise distance)."""
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double") + F.lit(eps))
    return F.sqrt(_dsum(F.transform(d, lambda v: v * v)))


def triples(embeddings: DataFrame) -> DataFrame:
    """Stand-in shape from the embeddings table: vec_id // 3 is the triple, vec_id % 3 the role
    (0 predicted, 1 target, 2 negative). In an incomplete triple the vector of the nearest earlier role, else of the next, stands
    for the missing one, so every vector is used."""
    e = embeddings.select((F.col("vec_id") / 3).cast("long").alias("triple"), (F.col("vec_id") % 3).alias("role"), "embedding")
    g = e.groupBy("triple").agg(*[F.first(F.when(F.col("role") == k, F.col("embedding")), ignorenulls=True).alias(f"r{k}") for k in range(3)])
    return g.select("triple", F.coalesce("r0", "r1", "r2").alias("z_pred"), F.coalesce("r1", "r0", "r2").alias("z_target"), F.coalesce("r2", "r1", "r0").alias("z_negative"))


def per_row(tr: DataFrame) -> DataFrame:
    """V1 and V5 parts per triple: cosine(pred, target), positive and negative distances."""
    return tr.select(
        "triple",
        cosine_similarity("z_pred", "z_target").alias("cosine"),
        pairwise_distance("z_pred", "z_target").alias("pos_dist"),
        pairwise_distance("z_pred", "z_negative").alias("neg_dist"),
    )


def invariance_loss(tr: DataFrame) -> DataFrame:
    """V2: mean squared difference between prediction and target over rows x dims, summed inside the
    row first (no row per dimension); doubles, so tiny and huge differences both count."""
    diff = F.zip_with("z_pred", "z_target", lambda x, y: x.cast("double") - y.cast("double"))
    rows = tr.select(_dsum(F.transform(diff, lambda v: v * v)).alias("sq"), F.size("z_pred").alias("d"))
    return rows.agg((F.sum("sq") / F.sum("d")).alias("invariance"))


def dim_std(tr: DataFrame, col: str) -> DataFrame:
    """Per-dimension sample std of one side: (dim, std), 0 for a single row; a row per vector and dimension, for users
    who want the values themselves."""
    ex = tr.select(F.posexplode(col).alias("dim", "v")).select("dim", F.col("v").cast("double").alias("v"))
    return ex.groupBy("dim").agg(F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))


SIDES = ("z_pred", "z_target")
STRIPE = 64                 # rows of a moment matrix that travel together
TEAM = 256                  # tasks whose moments are merged first
_MOMENTS = "side string, stripe int, team int, n long, mean array<double>, m2 array<double>"


def _merge(a: tuple, b: tuple) -> tuple:
    """Centred moments (n, mean, sum of squares and products about the mean) of two sets of rows as those of both."""
    (n, mean, m2), (k, other, more) = a, b
    gap = other - mean
    return n + k, mean + gap * (k / (n + k)), m2 + more + np.outer(gap, gap) * (n * k / (n + k))


def _task_moments(with_losses: bool):
    """Per task: centred moments of both sides in stripes of the matrix and, as side ``loss``, the sum of squared
    differences, the number of values, the sum of margins and the rows."""
    def run(batches):
        acc, loss = {}, np.zeros(4)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = {c: np.stack(pdf[c].to_numpy()).astype(np.float64) for c in pdf.columns}
            if with_losses:
                p, t, n = (x[c] for c in ("z_pred", "z_target", "z_negative"))
                near = np.sqrt(((p - t + R.PAIRWISE_EPS) ** 2).sum(axis=1))
                away = np.sqrt(((p - n + R.PAIRWISE_EPS) ** 2).sum(axis=1))
                loss += [((p - t) ** 2).sum(), p.size, np.maximum(0.0, near - away + R.CONTRASTIVE_MARGIN).sum(), len(p)]
            for side in SIDES:
                mean = x[side].mean(axis=0)
                off = x[side] - mean
                own = (len(pdf), mean, off.T @ off)
                acc[side] = _merge(acc[side], own) if side in acc else own
        team = TaskContext.get().partitionId() // TEAM
        rows = [("loss", -1, team, int(loss[3]), loss, [])] if acc and with_losses else []
        rows += [(side, at, team, n, mean, m2[at : at + STRIPE].ravel()) for side, (n, mean, m2) in acc.items() for at in range(0, len(mean), STRIPE)]
        if rows:
            yield pd.DataFrame(rows, columns=["side", "stripe", "team", "n", "mean", "m2"])
    return run


def _joined(pdf: pd.DataFrame) -> tuple:
    """The rows of one side and stripe merged: (side, stripe, n, mean, m2 by row)."""
    side, at = pdf["side"].iloc[0], int(pdf["stripe"].iloc[0])
    rows = sorted(zip(pdf["n"], pdf["mean"], pdf["m2"], strict=True), key=lambda r: (r[0], tuple(r[1])))
    if side == "loss":
        return side, at, sum(r[0] for r in rows), np.sum([r[1] for r in rows], axis=0), np.zeros((0, 0))
    n, mean, m2 = 0, None, None
    for k, other, more in rows:
        other, more = np.asarray(other), np.asarray(more).reshape(-1, len(other))
        if mean is None:
            n, mean, m2 = k, other, more
            continue
        gap = other - mean
        m2 = m2 + more + np.outer(gap[at : at + STRIPE], gap) * (n * k / (n + k))
        n, mean = n + k, mean + gap * (k / (n + k))
    return side, at, n, mean, m2


def _merge_team(pdf: pd.DataFrame) -> pd.DataFrame:
    side, at, n, mean, m2 = _joined(pdf)
    return pd.DataFrame({"side": [side], "stripe": [at], "team": [0], "n": [n], "mean": [mean], "m2": [m2.ravel()]})


def _stripe_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one stripe adds to the losses of its side: the sum of max(0, 1 - std) and of squared covariances beside the diagonal."""
    side, at, n, mean, m2 = _joined(pdf)
    if side == "loss":
        return pd.DataFrame({"side": "loss", "name": ["sq", "values", "margins", "rows"], "value": mean})
    cov = m2 / max(n - 1.0, 1.0)
    own = cov[np.arange(len(cov)), at + np.arange(len(cov))].copy()
    cov[np.arange(len(cov)), at + np.arange(len(cov))] = 0.0
    std = np.sqrt(np.maximum(own, 0.0)) if n > 1 else np.zeros(len(cov))
    return pd.DataFrame({"side": side, "name": ["short", "off", "dims"], "value": [float(np.maximum(0.0, 1.0 - std).sum()), float((cov**2).sum()), float(len(cov))]})


def _parts(tr: DataFrame, with_losses: bool = False) -> DataFrame:
    """One row with the parts of the losses, from one pass over the vectors.

    Means are subtracted before anything is squared, and the moments of tasks are merged pairwise with the gap between their
    means, so values far from zero keep the precision of their spread. Tasks send stripes of ``STRIPE`` rows of the
    matrix; those of ``TEAM`` tasks are merged first, then those of all teams, so no task holds more than some hundred stripes."""
    columns = [*SIDES, "z_negative"] if with_losses else list(SIDES)
    each = tr.select(*columns).mapInPandas(_task_moments(with_losses), _MOMENTS)
    teams = each.groupBy("side", "stripe", "team").applyInPandas(_merge_team, _MOMENTS)
    parts = teams.groupBy("side", "stripe").applyInPandas(_stripe_parts, "side string, name string, value double")
    pick = lambda side, name: F.sum(F.when((F.col("side") == side) & (F.col("name") == name), F.col("value")))
    return parts.agg(*[pick(s, n).alias(f"{s}_{n}") for s in SIDES for n in ("short", "off", "dims")],
                     *[pick("loss", n).alias(n) for n in ("sq", "values", "margins", "rows")])


def _variance() -> Column:
    return sum((F.col(f"{s}_short") / F.col(f"{s}_dims") for s in SIDES), F.lit(0.0))


def _covariance() -> Column:
    """Mean of squares beside the diagonal, both sides; 0 for one dimension, null without rows."""
    one = lambda s: F.when(F.col(f"{s}_dims") > 1, F.col(f"{s}_off") / F.greatest(F.col(f"{s}_dims") * (F.col(f"{s}_dims") - 1), F.lit(1.0))).otherwise(F.col(f"{s}_dims") * 0.0)
    return sum((one(s) for s in SIDES), F.lit(0.0))


def variance_loss(tr: DataFrame) -> DataFrame:
    """V3: mean over dims of max(0, 1 - sample std), prediction side plus target side; the std of a single row is 0."""
    return _parts(tr).select(_variance().alias("variance"))


def covariance_loss(tr: DataFrame) -> DataFrame:
    """V4: mean of squared off-diagonal covariances (divisor n - 1), prediction plus target, from merged centred moments."""
    return _parts(tr).select(_covariance().alias("covariance"))


def contrastive_loss(tr: DataFrame, margin: float = R.CONTRASTIVE_MARGIN) -> DataFrame:
    """V5: mean of max(0, d(pred, target) - d(pred, negative) + margin)."""
    r = per_row(tr)
    return r.agg(F.avg(F.greatest(F.lit(0.0), F.col("pos_dist") - F.col("neg_dist") + F.lit(margin))).alias("contrastive"))


def collapse_report(tr: DataFrame) -> DataFrame:
    """V6: the four losses and the weighted total 25*inv + 25*var + 1*cov + 10*contrastive, from one
    pass over the vectors."""
    one = _parts(tr, with_losses=True).select(
        (F.col("sq") / F.col("values")).alias("invariance"), _variance().alias("variance"), _covariance().alias("covariance"), (F.col("margins") / F.col("rows")).alias("contrastive"))
    w = dict(R.LOSS_WEIGHTS)
    total = None
    for n in one.columns:
        term = F.coalesce(F.col(n), F.lit(0.0)) * F.lit(w[n])
        total = term if total is None else total + term
    return one.select(*one.columns, total.alias("total"))


def mean_pool(tokens: DataFrame, key: str, vec: str, mask: str) -> DataFrame:
    """V7: masked mean of token vectors per key: sum(mask * x) / max(sum(mask), 1)."""
    ex = tokens.select(key, F.col(mask).cast("double").alias("_m"), F.posexplode(vec).alias("dim", "x"))
    g = ex.groupBy(key, "dim").agg(F.sum(F.col("_m") * F.col("x").cast("double")).alias("_s"), F.sum("_m").alias("_w"))
    g = g.select(key, "dim", (F.col("_s") / F.greatest(F.col("_w"), F.lit(1.0))).alias("v"))
    return g.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("pooled"))


def rerank(answers: DataFrame, group: str, idx: str, score: str) -> DataFrame:
    """Rank answers of each question by predicted overall score desc, original index on ties."""
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(idx))
    return answers.withColumn("rank", F.row_number().over(w))
