"""Scoring, ranking and best answers (J1, A1, W1-W3) with ties (T1) and empty errors."""

from pyspark.sql import functions as F

from chorus import schemas as S
from chorus.operators import scoring as SC


def _raw(spark, responses, judge_scores):
    rows = [{"seq": 1, "responses": responses, "judge": {"scores": judge_scores, "consensus_points": [],
                                                         "disagreement_points": [], "confidence": 0.6}}]
    schema = f"seq long, responses {S.T.ArrayType(S.RESPONSE).simpleString()}, judge {S.JUDGE.simpleString()}"
    return spark.createDataFrame(rows, schema)


def _r(name, error=None, content="c"):
    return {"model_id": name, "model_name": name, "provider": "p", "content": content, "reasoning_trace": None,
            "latency_ms": 1.0, "error": error}


def test_attach_first_match_missing_dims_and_unmatched(spark):
    judge = [
        {"model_index": 1.0, "accuracy": 1.0, "completeness": None, "reasoning_quality": 1.0, "clarity": 1.0},
        {"model_index": 1.0, "accuracy": 0.0, "completeness": 0.0, "reasoning_quality": 0.0, "clarity": 0.0},
        {"model_index": 0.0, "accuracy": 0.5, "completeness": 0.5, "reasoning_quality": 0.5, "clarity": 0.5},
    ]
    df = SC.score_entries(_raw(spark, [_r("a"), _r("b"), _r("c")], judge))
    ranked = df.select("ranked").first()[0]
    by = {r.model_name: r for r in ranked}
    assert by["b"].total_score == 1.0 * 0.35 + 0.0 * 0.25 + 1.0 * 0.20 + 1.0 * 0.10       # first match, missing = 0
    assert by["a"].total_score == 0.5 * 0.35 + 0.5 * 0.25 + 0.5 * 0.20 + 0.5 * 0.10
    assert by["c"].total_score == 0.0 and by["c"].scores == {}                          # unmatched
    assert [r.model_name for r in ranked] == ["b", "a", "c"] and [r.rank for r in ranked] == [1, 2, 3]


def test_rank_ties_keep_original_order(spark):
    judge = [{"model_index": float(i), "accuracy": 0.5, "completeness": 0.5, "reasoning_quality": 0.5, "clarity": 0.5}
             for i in range(3)]
    df = SC.score_entries(_raw(spark, [_r("x"), _r("y"), _r("z")], judge))
    assert [r.model_name for r in df.select("ranked").first()[0]] == ["x", "y", "z"]


def test_best_of_n_skips_errors_and_empty_error_is_ok(spark, make_log):
    from tests.conftest import entry, resp
    log = make_log([
        entry(1, responses=[resp("a", 0.9, error="boom"), resp("b", 0.5, content="B")]),
        entry(2, responses=[resp("a", 0.9, error="", content="")]),                       # T2: '' is no error
        entry(3, responses=[resp("a", 0.9, error="x")]),
    ])
    got = {r.seq: r.b for r in log.select("seq", SC.best_of_n(F.col("responses")).alias("b")).collect()}
    assert got == {1: "B", 2: "", 3: "All models failed to produce a response."}


def test_best_response_first_on_ties(spark, make_log):
    from tests.conftest import entry, resp
    log = make_log([entry(1, responses=[resp("a", 0.7), resp("b", 0.7), resp("c", 0.2)])])
    assert log.select(SC.best_response(F.col("responses"))["model_name"]).first()[0] == "a"


def test_total_latency_and_reasoning(spark):
    df = SC.to_raw_record(SC.score_entries(_raw(spark, [_r("a"), _r("b", error="e")], [])).select(
        "*", F.lit(5.0).alias("judge_ms"), F.lit("1").alias("id"), F.lit("t").alias("timestamp"), F.lit("q").alias("query"),
        F.lit(None).cast("string").alias("strategy"), F.lit("ans").alias("final_answer")))
    r = df.first()
    assert r.total_latency_ms == 7.0
    assert r.reasoning == "Synthesized from 1 model responses using weighted_merge"
    assert r.confidence == 0.6
