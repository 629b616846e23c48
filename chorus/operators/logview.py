"""Views of the log: exploding answers (S7), answer filters (P2, P3), display views (P10-P13),
recent entries (W4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import rules as R
from chorus.functions import text as TX
from chorus.operators.scoring import is_error, is_valid


def response_fields(*names: str, col: str = "responses"):
    """The answers reduced to the named fields, as an array of structs. Extracting fields of the
    array (``responses.model_name``) lets Parquet read only those leaves; the long answer texts
    stay on disk unless a query asks for them."""
    return F.arrays_zip(*[F.col(f"{col}.{n}").alias(n) for n in names])


def n_responses(col: str = "responses"):
    """Number of answers, read through one small field of the array."""
    return F.size(F.col(f"{col}.rank"))


def explode_responses(log: DataFrame, outer: bool = True, keep=("seq", "query", "strategy", "confidence")) -> DataFrame:
    """One row per answer (position = place in the stored array). ``outer`` keeps questions
    without answers as one row of nulls."""
    gen = F.posexplode_outer if outer else F.posexplode
    cols = [F.col(c) for c in keep]
    return log.select(*cols, gen("responses").alias("response_pos", "r")).select(
        *keep, "response_pos", "r.*")


def valid_responses(log: DataFrame) -> DataFrame:
    """Answers with no error and non-empty content."""
    ex = log.select("seq", F.posexplode(response_fields("model_name", "total_score", "rank", "error", "content")).alias("response_pos", "r"))
    return ex.filter(is_valid(F.col("r"))).select("seq", "response_pos", "r.model_name", "r.total_score", "r.rank")


def non_error_responses(log: DataFrame, resolve=None) -> DataFrame:
    """Answers with no error (empty content stays). ``resolve`` puts texts in the place of references in ``content``."""
    ex = log.select("seq", F.posexplode(response_fields("model_name", "total_score", "rank", "error", "content")).alias("response_pos", "r"))
    ok = ex.filter(~is_error(F.col("r"))).select("seq", "response_pos", "r.model_name", "r.total_score", "r.rank", "r.content")
    ok = ok if resolve is None else resolve(ok)
    return ok.withColumn("content_chars", F.length("content")).drop("content")


def recent_view(log: DataFrame) -> DataFrame:
    """P10: id, timestamp, first 120 characters of the query, confidence, strategy, model count."""
    return log.select(
        "seq", "id", "timestamp",
        F.substring("query", 1, R.RECENT_QUERY_CHARS).alias("query"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "strategy",
        F.coalesce(n_responses(), F.lit(0)).alias("num_models"),
    )


def recent_entries(log: DataFrame, n: int = 10) -> DataFrame:
    """The last n entries in append order (a top-n by seq, no global sort), oldest first."""
    return recent_view(log).orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def result_view(log: DataFrame) -> DataFrame:
    """One flat row per scored answer, with the four judge scores as columns."""
    ex = log.select("seq", F.posexplode("responses").alias("response_pos", "r"))
    return ex.select(
        "seq", "response_pos", "r.model_id", "r.model_name", "r.provider", "r.content", "r.reasoning_trace",
        "r.latency_ms", "r.error", F.col("r.total_score").alias("score"), "r.rank",
        *[F.try_element_at("r.scores", F.lit(n)).alias(n) for n, _ in R.SCORE_WEIGHTS],
    )


def response_preview(log: DataFrame, resolve=None) -> DataFrame:
    """Status flag, header and preview text of each answer as the CLI shows it. ``resolve`` puts texts in the place of references in ``content``."""
    ex = log.select("seq", F.posexplode(response_fields("content", "reasoning_trace", "latency_ms", "error", "total_score")).alias("response_pos", "r"))
    ex = ex.select("seq", "response_pos", "r.*")
    ex = ex if resolve is None else resolve(ex)
    r = {c: F.col(c) for c in ex.columns}
    err = is_error(r)
    content = F.coalesce(r["content"], F.lit(""))
    body = F.when(err, r["error"]).otherwise(
        F.concat(F.substring(content, 1, R.PREVIEW_CONTENT_CHARS),
                 F.when(F.length(content) > R.PREVIEW_CONTENT_CHARS, F.lit("...")).otherwise(F.lit(""))))
    trace = r["reasoning_trace"]
    body = F.when(F.coalesce(trace, F.lit("")) != "", F.concat(
        F.lit("Thinking: "), F.substring(trace, 1, R.PREVIEW_REASONING_CHARS), F.lit("...\n\n"), body)).otherwise(body)
    score = F.coalesce(r["total_score"], F.lit(0.0))
    return ex.select(
        "seq", "response_pos",
        F.when(err, "ERROR").otherwise("OK").alias("status"),
        F.when(score > 0, F.concat(F.lit("Score: "), TX.py_fixed(score, 2))).otherwise(F.lit("")).alias("score_text"),
        TX.py_fixed(F.coalesce(r["latency_ms"], F.lit(0.0)), 0).alias("latency_text"),
        body.alias("preview"),
    )


def result_summary(log: DataFrame) -> DataFrame:
    """The result summary text; optional lines are skipped when their list is empty."""
    n_cons = F.coalesce(F.size("consensus_points"), F.lit(0))
    n_dis = F.coalesce(F.size("disagreement_points"), F.lit(0))
    return log.select(
        "seq",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Query: "), F.substring("query", 1, R.SUMMARY_QUERY_CHARS), F.lit("...")),
            F.concat(F.lit("Strategy: "), F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY))),
            F.concat(F.lit("Models used: "), F.coalesce(n_responses(), F.lit(0)).cast("string")),
            F.concat(F.lit("Confidence: "), TX.percent0(F.coalesce("confidence", F.lit(0.0)))),
            F.concat(F.lit("Total latency: "), TX.py_fixed(F.coalesce("total_latency_ms", F.lit(0.0)), 0), F.lit("ms")),
            F.when(n_cons > 0, F.format_string("Consensus on %d points", n_cons)),
            F.when(n_dis > 0, F.format_string("Disagreements on %d points", n_dis)),
        ).alias("summary"),
    )
