"""Exact nearest vectors against numpy."""

import numpy as np
from pyspark.sql import functions as F

from chorus.operators import nearest as NN


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(NN, "QUERIES", 3)
    monkeypatch.setattr(NN, "VECTORS", 11)
    monkeypatch.setattr(NN, "MERGE", 2)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(120, 5))
    x[7] = x[8] = x[60]                      # ties
    x[40] = 0
    rows = [(i, x[i].tolist()) for i in range(120)] + [(None, [1.0] * 5), (500, None), (501, []), (600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in NN.nearest(df.repartition(5), F.col("vec_id") % 20 == 0, k=6).collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.score)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    score = np.round(unit @ unit.T, 6)
    for q in range(0, 120, 20):
        want = sorted((-score[q, j], j) for j in range(120) if j != q)[:6]
        assert [got[q][k + 1][0] for k in range(6)] == [j for _, j in want]
        assert np.allclose([got[q][k + 1][1] for k in range(6)], [-s for s, _ in want])
    assert set(got) == {0, 20, 40, 60, 80, 100}          # 600 has no other of its length
    assert NN.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
