"""Stable ids with forced collisions, and the catalog read from a configuration."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chorus.operators import catalog as CAT
from chorus.operators import ids as ID


def test_colliding_prefixes_are_lengthened_alone(spark):
    texts = [f"text {i}" for i in range(300)] + ["text 0", None]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, t string")
    got = {r.seq: r.short_id for r in ID.stable_ids(df.repartition(5), F.col("t"), lengths=(2, 3, 5, 64)).collect()}
    hashes = {t: hashlib.sha256(t.encode()).hexdigest() for t in texts if t is not None}
    for seq, t in enumerate(texts):
        if t is None:
            assert got[seq] is None
            continue
        want = next(n for n in (2, 3, 5, 64) if sum(h[:n] == hashes[t][:n] for h in hashes.values()) == 1)
        assert got[seq] == hashes[t][:want]
    assert {len(v) for v in got.values() if v} >= {2, 3, 5} and got[0] == got[300]
    assert ID.stable_ids(df.limit(0), F.col("t")).collect() == []
    with pytest.raises(ValueError):
        ID.stable_ids(df, F.col("t"), lengths=(8, 16))


def test_catalog_from_a_configuration(spark):
    config = {"providers": {"b": {"enabled": True, "models": [{"id": "m2", "name": "Two"}, {"id": "m1", "name": "One", "role": "judge"}]},
                            "a": {"models": [{"id": "m3", "name": "Three"}]}, "c": {"enabled": True}}}
    rows = CAT.catalog_from_config(spark, config).orderBy("config_order").collect()
    assert [(r.provider, r.enabled, r.model_id, r.model_name, r.role) for r in rows] == [("b", True, "m2", "Two", None), ("b", True, "m1", "One", "judge"), ("a", False, "m3", "Three", None)]
    assert [r.model_id for r in CAT.model_catalog(CAT.catalog_from_config(spark, config), {"b": "key"}).orderBy("config_order").collect()] == ["m2", "m1"]
    assert CAT.catalog_from_config(spark, {}).collect() == []
