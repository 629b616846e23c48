"""Faults found in review: latency after a debate, losses on extreme and empty inputs, pruned scans,
statistics defaults, missing logs and the shared folder."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus import schemas as S
from chorus.operators import logview as LV
from chorus.operators import pairs as PR
from chorus.operators import routing as RT
from chorus.operators import vectors as VC
from chorus.plans import dispatch as DP
from chorus.session import ensure_checkpoint_dir
from chorus.sources import fixtures as FX
from chorus.sources import io as IO
from tests.conftest import SF_SMALL, entry, resp
from tests.standin import standin_generate

TRIPLE = "triple long, z_pred array<double>, z_target array<double>, z_negative array<double>"


def test_debate_keeps_the_original_answers_latency(spark):
    answers = [{"model_id": f"m{i}", "model_name": f"model_{i}", "provider": "p", "content": f"answer {i}", "reasoning_trace": None,
                "latency_ms": ms, "error": None} for i, ms in enumerate((1000.0, 2000.0))]
    shape = ("question_id long, query string, strategy string, responses array<struct<model_id string, model_name string, provider string,"
             " content string, reasoning_trace string, latency_ms double, error string>>")
    q = spark.createDataFrame([(1, "q", "debate", answers), (2, "q", "best_of_n", answers)], shape)
    rec = {r.seq: r for r in DP.synthesize(q, standin_generate, {"model_id": "m0", "provider": "p"}, debate=1).collect()}
    assert rec[1].total_latency_ms >= 3000 and rec[2].total_latency_ms >= 3000
    assert rec[1].responses[0].content != rec[2].responses[0].content


@pytest.mark.parametrize("gap", [1e-5, 4e4, 2e9])
def test_invariance_of_tiny_and_huge_differences(spark, gap):
    tr = spark.createDataFrame([(i, [0.0, 1.0], [gap, 1.0 + gap], [5.0, 5.0]) for i in range(3)], TRIPLE).repartition(6)
    assert VC.invariance_loss(tr).first().invariance == pytest.approx(gap * gap, rel=1e-4)
    assert VC.collapse_report(tr).first().invariance == pytest.approx(gap * gap, rel=1e-4)


def test_losses_with_empty_partitions_and_empty_tables(spark):
    draw = np.random.default_rng(0).normal(size=(5, 3, 4))
    rows = [(i, *(x.tolist() for x in draw[i])) for i in range(5)]
    tr = spark.createDataFrame(rows, TRIPLE).repartition(12)
    want = 0.0
    for side in range(2):
        c = np.cov(draw[:, side].T)
        want += (c[~np.eye(4, dtype=bool)] ** 2).mean()
    report = VC.collapse_report(tr).first()
    assert VC.covariance_loss(tr).first().covariance == pytest.approx(want)
    assert report.covariance == pytest.approx(want)
    assert report.variance == pytest.approx(VC.variance_loss(tr).first().variance, abs=1e-7)
    assert report.contrastive == pytest.approx(VC.contrastive_loss(tr).first().contrastive, abs=1e-7)
    empty = tr.limit(0)
    assert VC.covariance_loss(empty).first().covariance is None
    assert VC.contrastive_loss(empty).first().contrastive is None
    assert VC.collapse_report(empty).first().invariance is None


def test_losses_of_huge_and_tiny_values(spark):
    row = lambda k, scale: (k, [scale * (k + 1.0), 0.0], [0.0, 0.0], [0.0, 0.0])
    schema = "triple long, z_pred array<float>, z_target array<float>, z_negative array<float>"
    huge = spark.createDataFrame([row(k, 1e12) for k in range(4)], schema)
    assert VC.contrastive_loss(huge).first().contrastive == pytest.approx(1.0)
    assert VC.variance_loss(huge).first().variance == pytest.approx(1.5)
    tiny = spark.createDataFrame([row(k, 1e-11) for k in range(4)], schema)
    first = VC.dim_std(tiny, "z_pred").orderBy("dim").first()
    assert first["std"] == pytest.approx(1e-11 * np.std([1, 2, 3, 4], ddof=1), rel=1e-5)


def _fields_read(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: (struct<.*)", plan))))


def test_scans_read_only_the_fields_in_use(spark, make_log, tmp_path):
    log = make_log([entry(1, "q", [resp("a"), resp("b")])])
    path = str(tmp_path / "log")
    IO.convert_log(log, path)
    stored = IO.scan_log_parquet(spark, path)
    # extraction of fields must reach the scan; long texts stay unread
    for df in (RT.model_perf(stored), RT.performance_by_type(stored), RT.strategy_perf(stored)):
        got = _fields_read(df)
        assert got and not got & {"content", "reasoning_trace", "scores", "provider", "final_answer"}, got
    for df in (LV.valid_responses(stored), LV.non_error_responses(stored), PR.debate_pairs(stored)):
        assert not _fields_read(df) & {"reasoning_trace", "scores", "provider", "final_answer"}


def test_missing_log_gives_no_rows(spark, tmp_path):
    assert IO.scan_log(spark, str(tmp_path / "none")).schema == S.RAW_LOG
    assert IO.scan_log(spark, str(tmp_path / "none")).count() == 0


def test_stats_defaults_sizes_and_half_even_rounding(spark, tmp_path):
    path, data = str(tmp_path / "stats"), tmp_path / "data"
    data.mkdir()
    (data / "f.bin").write_bytes(b"x" * (1024 * 1024 // 8))
    assert IO.file_size_mb(spark, str(data)).first().size_mb == 0.12          # 0.125, half to even
    stats = spark.createDataFrame([(3, 7)], "total_queries long, total_responses long")
    IO.write_stats(stats, path, str(data), str(tmp_path / "absent"))
    st = IO.read_stats(spark, path).first()
    assert (st.total_queries, st.raw_file_mb, st.training_file_mb, st.training_pairs, st.model_counts) == (3, 0.12, 0.0, 0, {})
    assert spark.read.json(path).first().last_updated


class _Elsewhere:
    """A session of a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def getCheckpointDir():
                class none:
                    @staticmethod
                    def isPresent():
                        return False
                return none


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(_Elsewhere)


def test_fixture_reads_whole_documents_and_many_questions(spark):
    log = FX.ensemble_log(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    answers = log.select(F.explode("responses.content").alias("text")).where("text <> ''").distinct()
    assert answers.join(docs.select("text"), "text", "left_anti").count() == 0
    used = answers.unionByName(log.select(F.col("final_answer").alias("text"))).distinct()
    assert docs.select("text").distinct().join(used, "text", "left_anti").count() == 0
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").where("role = 'user'").select(F.translate("text", "\r\n", "  ").alias("text"))
    asked = log.select("query").distinct()
    assert turns.join(asked, F.expr("startswith(query, text)"), "left_anti").count() == 0
