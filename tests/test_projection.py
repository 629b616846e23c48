"""The trained projection against a numpy run, its falling losses and its resumption."""

import random
import shutil

import numpy as np
import pytest

from chorus.functions import rules as R
from chorus.plans import ml as ML
from chorus.plans import projection as PJ
from tests.test_scorers import fold

TRIPLE = "triple long, z_pred array<double>, z_target array<double>, z_negative array<double>"


def numpy_run(x, epochs, batches, rate):
    w, out = np.eye(x.shape[2]), []
    lw = dict(R.LOSS_WEIGHTS)
    folds = np.array([fold(i, batches) for i in range(len(x))])
    for epoch in range(epochs):
        order = list(range(batches))
        random.Random(epoch).shuffle(order)
        for b in order:
            p, t, z = (x[folds == b, k] for k in range(3))
            if not len(p):
                continue
            slope, inv, con = np.zeros_like(w), 0.0, 0.0
            for pi, ti, zi in zip(p, t, z, strict=True):
                to, away = w @ pi - ti, w @ pi - zi
                near, far = np.linalg.norm(to + R.PAIRWISE_EPS), np.linalg.norm(away + R.PAIRWISE_EPS)
                g = lw["invariance"] * 2 * to / len(pi)
                if near - far + R.CONTRASTIVE_MARGIN > 0:
                    g = g + lw["contrastive"] * ((to + R.PAIRWISE_EPS) / near - (away + R.PAIRWISE_EPS) / far)
                slope += np.outer(g, pi)
                inv += (to * to).mean()
                con += max(0.0, near - far + R.CONTRASTIVE_MARGIN)
            out.append((epoch, b, len(p), inv / len(p), con / len(p)))
            w = w - rate * slope / len(p)
    return out


def test_training_equals_numpy_falls_and_resumes(spark, tmp_path):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(60, 3, 4))
    x[:, 1] = x[:, 0] @ draw.normal(size=(4, 4)) * 0.5
    tr = spark.createDataFrame([(i, *(v.tolist() for v in x[i])) for i in range(60)], TRIPLE)
    path = str(tmp_path / "run")
    metrics = PJ.train(spark, tr.repartition(5), path, epochs=3, batches=4)
    want = {(e, b): (n, i, c) for e, b, n, i, c in numpy_run(x, 3, 4, PJ.RATE)}
    got = {(r.epoch, r.batch): (r.n, r.invariance, r.contrastive) for r in metrics.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    means = sorted((r.epoch, r.total) for r in ML.epoch_means(metrics).collect())
    assert means[0][1] > means[1][1] > means[2][1]
    assert ML.best_epoch(ML.epoch_means(metrics)).first().best_epoch == 2
    shutil.rmtree(f"{path}/metrics/epoch-2")                      # the driver was lost in the last epoch
    again = {(r.epoch, r.batch): (r.n, r.invariance, r.contrastive) for r in PJ.train(spark, tr.repartition(2), path, epochs=3, batches=4).collect()}
    assert all(again[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert PJ.train(spark, tr.limit(0), str(tmp_path / "none")).collect() == []
