"""Cross-fitted ridge and the reward model against numpy and on held-out rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.operators import reward as RW
from chorus.operators import ridge as RG
from chorus.plans import ml as ML


def fold(key, folds=RG.FOLDS):
    return int(hashlib.md5(str(key).encode()).hexdigest()[:6], 16) % folds


@pytest.mark.parametrize("offset,partitions", [(0.0, 1), (1e6, 7)])
def test_ridge_equals_the_closed_form_of_the_other_folds(spark, offset, partitions):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(300, 9))
    y = np.stack([x @ draw.normal(size=9) + 0.1 * draw.normal(size=300), x[:, 0] ** 2], 1)
    df = spark.createDataFrame([(i, (x[i] + offset).tolist(), float(y[i, 0]), float(y[i, 1])) for i in range(300)], "id long, x array<double>, a double, b double").repartition(partitions)
    own = RG.fold_of(F.col("id"))
    got = {r.id: r for r in RG.predicted(df, "x", RG.cross_fit(df, "x", [F.col("a"), F.col("b")], own), own, ["pa", "pb"]).collect()}
    folds = np.array([fold(i) for i in range(300)])
    for k in range(RG.FOLDS):
        rest = folds != k
        mean_x, mean_y = x[rest].mean(0), y[rest].mean(0)
        c = x[rest] - mean_x
        beta = np.linalg.solve(c.T @ c / rest.sum() + RG.RIDGE * np.eye(9), c.T @ (y[rest] - mean_y) / rest.sum())
        for i in np.flatnonzero(folds == k):
            want = mean_y + (x[i] - mean_x) @ beta
            assert [got[i].pa, got[i].pb] == pytest.approx(want, abs=1e-6)
            assert [got[i].pa_mean, got[i].pb_mean] == pytest.approx(mean_y)
    rows = {r.target: r for r in RG.held_out(RG.predicted(df, "x", RG.cross_fit(df, "x", [F.col("a")], own), own, ["a_score"]), {"a_score": F.col("a")}).collect()}
    assert rows["a_score"].n == 300 and rows["a_score"].r2 > 0.95


def test_one_feature_equals_the_slope_of_sql(spark):
    rows = [(i, float(i % 17), 3.0 * (i % 17) + (i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v double, y double").select("id", F.array("v").alias("x"), "v", "y")
    fitted = {r.fit_fold: r for r in RG.cross_fit(df, "x", [F.col("y")], RG.fold_of(F.col("id")), ridge=0.0).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, v DOUBLE, y DOUBLE, k INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(*r, fold(r[0])) for r in rows])
    for k, row in fitted.items():
        slope, intercept, n = con.execute(f"SELECT regr_slope(y, v), regr_intercept(y, v), count(*) FROM t WHERE k <> {k}").fetchone()
        assert (row.beta[0][0], row.intercept[0], row.n) == (pytest.approx(slope), pytest.approx(intercept), n)


def test_ridge_of_odd_rows(spark):
    df = spark.createDataFrame([(i, None if i == 0 else [1.0, float(i)], None if i == 1 else 2.0) for i in range(30)], "id long, x array<double>, y double")
    own = RG.fold_of(F.col("id"))
    got = RG.predicted(df, "x", RG.cross_fit(df, "x", [F.col("y")], own), own, ["p"]).collect()
    assert len(got) == 30 and all(r.p == pytest.approx(2.0) for r in got if r.id != 0) and [r.p for r in got if r.id == 0] == [None]
    assert RG.predicted(df.limit(0), "x", RG.cross_fit(df.limit(0), "x", [F.col("y")], own), own, ["p"]).collect() == []


def test_scorers_never_see_their_row(spark):
    draw = np.random.default_rng(8)
    e = spark.createDataFrame([(i, i % 10, draw.normal(size=6).tolist()) for i in range(301)], "vec_id long, label int, embedding array<double>")
    report = {r.target: r for r in ML.quality_report(ML.embedding_features(e)).collect()}
    assert len(report) == 4 and all(r.n == 301 and r.r2 < 0.1 for r in report.values())         # noise cannot be learned
    g = ML.grounding_report(ML.VC.triples(e)).first()
    assert g.n == 202 and g.majority == 0.5 and 0.3 < g.accuracy < 0.7
    assert ML.embedding_evaluate(e).count() == 101


def pairs_of(n, seed):
    draw = random.Random(seed)
    good, bad, plain = ["clear", "step", "proof"], ["maybe", "unsure", "whatever"], [f"w{i}" for i in range(60)]
    text = lambda own: " ".join(draw.choice(own) if draw.random() < 0.2 else draw.choice(plain) for _ in range(40))
    return [(i // 2, text(good), text(bad)) for i in range(n)]


def test_reward_model_orders_held_out_pairs(spark):
    rows = pairs_of(400, 1)
    pairs = spark.createDataFrame(rows, "seq long, chosen string, rejected string")
    stored = RW.pair_rows(pairs.repartition(6))
    weights = RW.fit(stored)
    figures = RW.report(stored, weights).first()
    assert figures.n_held_out == sum(fold(r[0]) == 0 for r in rows) and figures.n_learned == 400 - figures.n_held_out
    assert figures.held_out_accuracy > 0.95
    assert np.allclose(weights, RW.fit(RW.pair_rows(pairs.repartition(3))))
    assert (RW.load(spark, RW.save(spark, weights)) == weights).all()
    # the optimum: the penalised gradient vanishes compared with where it began
    slots = [[(RW._vector(np.array(s)) if len(s) else None) for s in (r.a, r.b)] for r in pairs.where(RG.fold_of(F.col("seq")) != 0).select(RW.word_slots(F.col("chosen")).alias("a"), RW.word_slots(F.col("rejected")).alias("b")).collect()]
    x = np.zeros((len(slots), RW.FEATURES))
    for k, ((a, u), (b, v)) in enumerate(slots):
        np.add.at(x[k], a, u)
        np.add.at(x[k], b, -v)
    slope = lambda w: -(x / (1 + np.exp(x @ w))[:, None]).mean(0) + RW.PENALTY * w
    assert np.linalg.norm(slope(weights)) < 0.25 * np.linalg.norm(slope(np.zeros(RW.FEATURES)))
    scored = {r.k: r.reward for r in RW.rewards(spark.createDataFrame([(0, "clear proof step"), (1, "maybe whatever"), (2, ""), (3, None)], "k int, content string"), weights).collect()}
    assert scored[0] > 0 > scored[1] and scored[2] == scored[3] == 0.0


def test_reward_model_without_pairs(spark):
    stored = RW.pair_rows(spark.createDataFrame([], "seq long, chosen string, rejected string"))
    weights = RW.fit(stored)
    assert not weights.any() and RW.report(stored, weights).first().n_learned == 0
    same = RW.pair_rows(spark.createDataFrame([(1, "a b", "a b"), (2, "", None)], "seq long, chosen string, rejected string"))
    assert not RW.fit(same).any()


def test_gradient_of_a_batch_is_that_of_its_rows():
    import pyarrow as pa

    weights = np.linspace(-1, 1, 8)
    rows = [([0, 3], [0.5, -0.5]), ([], []), ([3, 7], [1.0, 0.25])]
    batch = pa.RecordBatch.from_pydict({"fold": [1, 2, 3], "slots": pa.array([s for s, _ in rows], pa.list_(pa.int32())), "values": pa.array([v for _, v in rows], pa.list_(pa.float64()))})
    want = np.zeros(8)
    for s, v in rows[1:]:
        np.add.at(want, np.array(s, int), -1 / (1 + np.exp(weights[np.array(s, int)] @ np.array(v))) * np.array(v))
    # a slice shares its parent's elements
    total, n = np.zeros(8), 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(RW, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
        for got in RW._gradients(weights)(iter([batch.slice(1, 2), batch.slice(0, 0)])):
            n, total = got.column("n")[0].as_py(), np.array(got.column("total")[0].as_py())
    assert n == 2 and np.allclose(total, want, atol=1e-12)
