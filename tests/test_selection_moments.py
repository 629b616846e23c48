"""Exact selection against sorted lists, and centred moments of values far from zero."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.operators import prepare as PP
from chorus.operators import selection as SEL
from chorus.operators import vectors as VC
from chorus.plans import ml as ML

TRIPLE = "triple long, z_pred array<double>, z_target array<double>, z_negative array<double>"


def test_kth_of_digits_with_ties(spark):
    draw = random.Random(1)
    values = [f"{draw.randrange(40):08x}" for _ in range(300)] + [f"{draw.randrange(1 << 32):08x}" for _ in range(300)]
    table = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    for digits in (1, 2, 4):
        for k in (1, 2, 299, 300, 301, 600):
            assert SEL.kth_digits(table, "v", k, digits) == sorted(values)[k - 1]
    with pytest.raises(ValueError):
        SEL.kth_digits(table, "v", 601)


@pytest.mark.parametrize("partitions", [1, 8, 211])
def test_kth_double_of_any_spread(spark, partitions):
    draw = random.Random(2)
    values = [draw.gauss(0, 1) for _ in range(200)] + [0.0, -0.0, 5e-324, 1e308, -1e308, 1.0, math.nextafter(1.0, 2)] + [7.25] * 100 + [10.0**k for k in range(-300, 300, 10)]
    table = spark.createDataFrame([(v,) for v in values], "v double").repartition(partitions)
    for k in (1, 2, 100, 150, 250, len(values) - 1, len(values)):
        assert SEL.kth_double(table, "v", k, buckets=16) == sorted(values)[k - 1]


@pytest.mark.parametrize("partitions", [1, 8, 211])
def test_split_members_do_not_depend_on_partitions(spark, partitions):
    n, seed = 2000, 42
    import hashlib
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    got = PP.shuffle_split(spark.range(n).withColumnRenamed("id", "seq").repartition(partitions))
    assert {r.seq for r in got.where("split = 'train'").collect()} == set(order[:1800])
    assert PP.shuffle_split(got.drop("split").limit(0)).collect() == []


@pytest.mark.parametrize("quantile", [0.0, 0.3, 0.5, 1.0])
def test_rejection_keeps_from_the_exact_quantile_on(spark, quantile):
    draw = random.Random(3)
    rewards = [round(draw.gauss(0, 1), 1) for _ in range(501)]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(rewards)] + [(900, None), (901, float("nan"))], "seq long, reward double")
    cut = sorted(rewards)[max(1, math.ceil(quantile * 501)) - 1]
    want = {i for i, r in enumerate(rewards) if r >= cut}
    for partitions in (1, 17):
        assert {r.seq for r in ML.rejection_filter(rows.repartition(partitions), quantile).collect()} == want
    assert ML.rejection_filter(rows.limit(0)).collect() == []


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
@pytest.mark.parametrize("partitions", [1, 9])
def test_moments_far_from_zero(spark, offset, partitions):
    draw = np.random.default_rng(4).normal(size=(400, 3, 70)) * 0.2
    draw[:, :, 1] = draw[:, :, 0] * 0.9 + draw[:, :, 1] * 0.1
    moved = draw + offset
    tr = spark.createDataFrame([(i, *(x.tolist() for x in moved[i])) for i in range(400)], TRIPLE).repartition(partitions)
    covariance = variance = 0.0
    for side in range(2):
        x = moved[:, side] - offset
        c = np.cov(x.T)
        covariance += (c[~np.eye(70, dtype=bool)] ** 2).mean()
        variance += np.maximum(0, 1 - x.std(axis=0, ddof=1)).mean()
    report = VC.collapse_report(tr).first()
    assert report.covariance == pytest.approx(covariance, rel=1e-6)
    assert report.variance == pytest.approx(variance, rel=1e-6)
    assert VC.covariance_loss(tr).first().covariance == pytest.approx(covariance, rel=1e-6)
    assert VC.variance_loss(tr).first().variance == pytest.approx(variance, rel=1e-6)


def test_one_row_one_dimension_and_teams(spark, monkeypatch):
    one = spark.createDataFrame([(0, [1.0], [2.0], [3.0])], TRIPLE)
    assert VC.covariance_loss(one).first().covariance == 0.0 and VC.variance_loss(one).first().variance == 2.0
    monkeypatch.setattr(VC, "TEAM", 2)
    monkeypatch.setattr(VC, "STRIPE", 3)
    draw = np.random.default_rng(5).normal(size=(60, 3, 7))
    tr = spark.createDataFrame([(i, *(x.tolist() for x in draw[i])) for i in range(60)], TRIPLE).repartition(9)
    want = sum(((c := np.cov(draw[:, s].T))[~np.eye(7, dtype=bool)] ** 2).mean() for s in range(2))
    assert VC.covariance_loss(tr).first().covariance == pytest.approx(want)


def test_no_vector_is_lost(spark):
    e = spark.createDataFrame([(i, [float(i)]) for i in (0, 1, 2, 3, 4, 7, 11)], "vec_id long, embedding array<double>")
    got = {r.triple: (r.z_pred[0], r.z_target[0], r.z_negative[0]) for r in VC.triples(e).collect()}
    assert got == {0: (0, 1, 2), 1: (3, 4, 4), 2: (7, 7, 7), 3: (11, 11, 11)}
    assert VC.triples(e.where(F.col("vec_id") < 0)).collect() == []
