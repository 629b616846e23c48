"""Reasoning traces: critique and verification parsing (F16-F18) and the per-question rollup of
trace steps (T-8). Steps are a child table keyed by (query_id, step_no)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import text as TX


def parsed(texts: DataFrame) -> DataFrame:
    """F16 + F17 + F18 on critique and verification texts."""
    c = TX.parse_critique(F.col("critique"))
    v = TX.parse_verification(F.col("verification"))
    out = texts.select("*", c.alias("_c"), v.alias("verification_confidence"))
    return out.select("*", F.col("_c.confidence").alias("critique_confidence"), F.col("_c.issues").alias("issues")).drop("_c").withColumn(
        "needs_refinement", TX.needs_refinement(F.col("verification_confidence"), F.col("issues")))


def conversation_steps(turns: DataFrame) -> DataFrame:
    """Trace steps (D17 rows) of reviewed turns: ``conv_id``, ``turn``, ``role``, ``text``, ``critique``, ``verification``.

    A conversation is a trace. Its opening turns decompose the question, an assistant's turn reasons, or refines after
    turn 2, and is verified; later user turns are critiques. Step 2 * turn is the turn itself, the odd one its verification."""
    p = parsed(turns)
    late, no = F.col("turn") > 2, (2 * F.col("turn")).cast("int")
    answers = F.col("role") == "assistant"
    criticised = late & (F.col("role") == "user")
    none = F.array().cast("array<string>")
    stage = F.when(answers, F.when(late, "refine").otherwise("reason")).when(criticised, "critique").otherwise("decompose")
    own = p.select(F.col("conv_id").alias("query_id"), no.alias("step_no"), stage.alias("stage"),
                   F.when(criticised, F.col("critique")).otherwise(F.col("text")).alias("output_text"),
                   F.when(criticised, F.col("critique_confidence")).alias("confidence"),
                   F.when(criticised, F.col("issues")).otherwise(none).alias("issues_found"))
    checks = p.filter(answers).select(F.col("conv_id").alias("query_id"), (no + 1).alias("step_no"), F.lit("verify").alias("stage"),
                                      F.col("verification").alias("output_text"), F.col("verification_confidence").alias("confidence"),
                                      none.alias("issues_found"))
    return own.unionByName(checks)


def trace_rollup(steps: DataFrame) -> DataFrame:
    """T-8: per question, the last answer (latest reason or refine step), the confidence of the
    latest verification, and the number of refinements. Step numbers are unique in a trace.

    Latest steps are maxima of numbers in a hash aggregate; the one answer a question needs is
    fetched by its step afterwards, so texts are neither sorted nor aggregated."""
    answers, checks = F.col("stage").isin("reason", "refine"), F.col("stage") == "verify"
    g = steps.groupBy("query_id").agg(F.max(F.when(answers, F.col("step_no"))).alias("_answer"), F.max(F.when(checks, F.col("step_no"))).alias("_check"),
                                      F.count_if(F.col("stage") == "refine").alias("num_refinements"))
    texts = steps.filter(answers).select("query_id", F.col("step_no").alias("_answer"), F.col("output_text").alias("final_answer"))
    sure = steps.filter(checks).select("query_id", F.col("step_no").alias("_check"), F.col("confidence").alias("overall_confidence"))
    return g.join(texts, ["query_id", "_answer"], "left").join(sure, ["query_id", "_check"], "left").select(
        "query_id", "final_answer", "overall_confidence", "num_refinements")
