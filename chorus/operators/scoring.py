"""Scoring and ranking of answers (J1, A1, A2, W1, W2, W3) and the raw-record builder (K2).

All per-question work is done inside the row with array functions: the answers of one question
travel together in one array, so attaching the judge's scores, computing weighted totals and
ranking need no shuffle at all, however many questions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions import rules as R


def weighted_total(accuracy, completeness, reasoning_quality, clarity, weights=None) -> Column:
    """A1: 0.35*accuracy + 0.25*completeness + 0.20*reasoning + 0.10*clarity, summed left to right."""
    w = dict(weights or R.SCORE_WEIGHTS)
    parts = [accuracy, completeness, reasoning_quality, clarity]
    names = [n for n, _ in R.SCORE_WEIGHTS]
    total = None
    for name, part in zip(names, parts):
        term = F.coalesce(part, F.lit(0.0)) * F.lit(float(w[name]))
        total = term if total is None else total + term
    return total


def total_from_map(scores) -> Column:
    """A1 over a scores map; a missing dimension counts 0."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return weighted_total(*[F.try_element_at(s, F.lit(n)) for n, _ in R.SCORE_WEIGHTS])


def attach_scores(responses, judge_scores) -> Column:
    """Give response i the first judge entry whose model_index equals i (left outer, first
    match wins). Matched: scores map of the four dimensions (missing = 0) and their weighted total.
    Unmatched: empty map and total 0. Returns the responses with ``scores`` and ``total_score``
    and a 0-based ``response_index``, in the original order."""
    # The judge's entries are made once per question (js), and looked up once per answer; the fields below read the struct.
    matched = F.get(F.transform(F.array(F.coalesce(judge_scores, F.array())), lambda js: F.transform(responses, lambda r, i: F.struct(
        r.alias("r"), i.alias("i"),
        F.get(F.filter(js, lambda s: s["model_index"] == i.cast("double")), 0).alias("h")))), 0)

    def one(x):
        r, hit = x["r"], x["h"]
        dims = [F.coalesce(hit[n], F.lit(0.0)) for n, _ in R.SCORE_WEIGHTS]
        scores = F.when(hit.isNull(), F.create_map().cast("map<string,double>")).otherwise(
            F.create_map(*[x for (n, _), d in zip(R.SCORE_WEIGHTS, dims) for x in (F.lit(n), d)])
        )
        total = F.when(hit.isNull(), F.lit(0.0)).otherwise(weighted_total(*dims))
        return F.struct(
            x["i"].alias("response_index"),
            r["model_id"].alias("model_id"), r["model_name"].alias("model_name"),
            r["provider"].alias("provider"), r["content"].alias("content"),
            r["reasoning_trace"].alias("reasoning_trace"), r["latency_ms"].alias("latency_ms"),
            r["error"].alias("error"), scores.alias("scores"), total.alias("total_score"),
        )

    return matched, one


def rank_responses(scored) -> Column:
    """Stable sort by total descending (ties keep the original order); rank = 1..n.
    Errored answers are ranked too. Returns the array in rank order, as the log stores it."""
    # the scored answers are made once per question (s), and read once per answer
    def ranked(s):
        order = F.sort_array(F.transform(s, lambda x, p: F.struct((-x["total_score"]).alias("k"), p.alias("p"))))
        return F.transform(order, lambda o, p: F.struct(
            *[F.get(s, o["p"])[f].alias(f) for f in ("model_id", "model_name", "provider", "content", "reasoning_trace",
                                                     "latency_ms", "error", "scores", "total_score")],
            (p + 1).alias("rank"),
        ))

    return F.get(F.transform(F.array(scored), ranked), 0)


def computed_here(x) -> Column:
    """``x``, which no later filter takes with it: Spark moves a filter below the projection that makes its columns, and then
    evaluates them for the filter and again for the result, unless they depend on where they are evaluated."""
    return F.when(F.spark_partition_id() >= 0, x)


def is_error(r) -> Column:
    """An empty error string is no error."""
    return F.coalesce(r["error"], F.lit("")) != ""


def is_valid(r) -> Column:
    """No error and non-empty content."""
    return (~is_error(r)) & (F.coalesce(r["content"], F.lit("")) != "")


def best_of_n(ranked) -> Column:
    """Content of the first non-error answer in rank order, else the fixed fallback text."""
    first_ok = F.get(F.filter(ranked, lambda r: ~is_error(r)), 0)
    return F.when(first_ok.isNull(), F.lit(R.ALL_FAILED_TEXT)).otherwise(first_ok["content"])


def best_response(responses) -> Column:
    """Argmax of total_score, the first one on ties (never ``max_by``, see T1)."""
    keyed = F.transform(responses, lambda x, i: F.struct(
        F.coalesce(x["total_score"], F.lit(0.0)).alias("k"), (-i).alias("i")))
    return F.get(responses, -F.array_max(keyed)["i"])


def total_latency(original_responses, overhead_ms) -> Column:
    """A2: judge/synthesis wall time plus the latencies of the original answers."""
    lat = F.aggregate(original_responses, F.lit(0.0), lambda acc, r: acc + F.coalesce(r["latency_ms"], F.lit(0.0)))
    return F.coalesce(overhead_ms, F.lit(0.0)) + lat


def synthesis_reasoning(ranked, strategy) -> Column:
    """The record's reasoning line: number of non-error answers and the strategy used."""
    n_ok = F.size(F.filter(ranked, lambda r: ~is_error(r)))
    return F.format_string("Synthesized from %d model responses using %s", n_ok,
                           F.coalesce(strategy, F.lit(R.DEFAULT_STRATEGY)))


def score_entries(df: DataFrame) -> DataFrame:
    """J1 + A1 + W1 per entry: ``responses`` (raw answers, original order) and ``judge`` (parsed
    judge reply) become ``responses`` scored and in rank order, plus confidence and points."""
    matched, one = attach_scores(F.col("responses"), F.col("judge.scores"))
    return (
        df.withColumn("_matched", matched)
        .withColumn("_scored", F.transform("_matched", one))
        .withColumn("ranked", computed_here(rank_responses(F.col("_scored"))))
        .drop("_matched", "_scored")
    )


def to_raw_record(df: DataFrame) -> DataFrame:
    """K2: a scored entry -> the raw log record (D7). Inputs: seq, id, timestamp, query, strategy,
    final_answer, judge, judge_ms, responses (original), ranked (from ``score_entries``)."""
    return df.select(
        "seq", "id", "timestamp", "query", "strategy",
        F.coalesce(F.col("judge.confidence"), F.lit(0.5)).alias("confidence"),
        "final_answer",
        synthesis_reasoning(F.col("ranked"), F.col("strategy")).alias("reasoning"),
        F.coalesce(F.col("judge.consensus_points"), F.array().cast("array<string>")).alias("consensus_points"),
        F.coalesce(F.col("judge.disagreement_points"), F.array().cast("array<string>")).alias("disagreement_points"),
        total_latency(F.col("responses"), F.col("judge_ms")).alias("total_latency_ms"),
        F.col("ranked").alias("responses"),
    )
