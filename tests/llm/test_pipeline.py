"""The corpus pipeline from end to end, and the stages' own parts that move whole rows."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chorus.llm import jaccard, shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n):
    return [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('lmnrst')}{draw.choice('aeiou')}{i % 7}" for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    """Documents with labels and a benchmark: good and bad ones, copies, near copies and one with a benchmark passage."""
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 2 == 0
        own = words(draw, 80)
        text = " ".join(own) + "." if good else " ".join(f"{w}### &&& !!!" for w in own[:30])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    item = " ".join(words(draw, 30))
    rows.append((1000, " ".join(words(draw, 40)) + " " + item + " " + " ".join(words(draw, 40)), "en", "s0", 0))
    near = rows[0][1].split()
    near[70] = "changed7"
    rows += [(1001, rows[0][1], "en", "s1", 0), (1002, " ".join(near), "en", "s2", 0), (1003, None, "en", "s0", 0), (1004, "", None, None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r for r in rows}


def test_pipeline_end_to_end(spark, folder):
    path, given = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = out.collect()
    kept = {r.doc_id for r in got}
    assert not any(i % 2 for i in kept if i < 400)                        # bad ones go
    assert {i for i in range(0, 400, 6)} <= kept                          # clean ones of the source that the mix repeats all stay
    rows = {s: sum(r.source == s for r in got) for s in ("s0", "s1", "s2")}
    assert all(abs(rows[s] - sum(rows.values()) * w / 8) < 12 for s, w in (("s0", 5), ("s1", 2), ("s2", 1)))
    assert not kept & {1001, 1002}                                        # a copy and a near copy of 0
    assert 1000 not in kept                                               # benchmark passage
    assert all(tuple(r)[:5] == given[r.doc_id] for r in got)              # rows as they were
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and max(by_shard) < 24
    sizes = [len(by_shard.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_without_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_ids_go_by_broadcast_and_by_bloom_filter_alike(spark):
    docs = spark.range(5000).select((F.col("id") % 3000).cast("int").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("listed_id"), F.lit(2).alias("bloom_block"))
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("int")))
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "doc_id").unionByName(spark.range(1).select(F.lit(None).cast("long").alias("doc_id")))
    for inside, rule in ((False, "doc_id is null or doc_id % 7 <> 0"), (True, "doc_id % 7 = 0")):
        want = sorted(map(str, docs.where(rule).collect()))
        assert sorted(map(str, jaccard.by_ids(docs, ids, inside).collect())) == want
        assert sorted(map(str, jaccard.by_ids(docs, ids, inside, most=10).collect())) == want


def test_many_identical_rows_spread_over_shards(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 3000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("shard"), F.lit(1).alias("row_spot"))
    out = shards.shuffled(df, shards=6, per_partition=500)
    assert out.columns == ["shard", "row_spot", "shard_", "slot"]
    got = out.groupBy("shard_").agg(F.count("*").alias("n"), F.sum((F.col("shard") == "same").cast("int")).alias("same"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert all(r.n == r.slots == r.last + 1 == 1000 and 400 < r.same < 600 for r in got) and len(got) == 6
