"""Further named queries: judge replies and prompts, critique parsing and trace rollups, vendor
payloads, the JSON round trip of the log, streaming, dispatch and learned scorers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from chorus.functions import rules as R
from chorus.operators import judge as JD
from chorus.operators import logview as LV
from chorus.operators import scoring as SC
from chorus.operators import traces as TR
from chorus.plans.registry import log_of, query, slim_log_of
from chorus.session import ensure_checkpoint_dir
from chorus.sources import fixtures as FX
from chorus.sources import io as IO


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "chorus", f"{name}-{uuid.uuid4().hex[:12]}")


# --- judge replies and prompts ---------------------------------------------------------------------

def _replies(spark, sf):
    return JD.standin_judge_replies(FX.raw_entries(spark, sf, refs=True))


@query("extract_judge_json")
def q_extract_judge(spark, sf):
    """which replies hold JSON, and how many score entries it has."""
    r = _replies(spark, sf).select("seq", JD.TX.extract_judge_json("judge_text").alias("v"))
    return r.select("seq", F.col("v").isNotNull().alias("parsed"),
                    F.coalesce(F.size(F.try_variant_get("v", "$.scores", JD.TX.JUDGE_SCORES_TYPE)), F.lit(0)).alias("n_scores"))


@query("judge_fields")
def q_judge_fields(spark, sf):
    """F11 + F12 + J1 + A1: totals and confidence recomputed from the parsed reply texts."""
    r = _replies(spark, sf).select("seq", "responses", JD.parse_judge_reply("judge_text").alias("j"))
    matched, one = SC.attach_scores(F.col("responses"), F.col("j.scores"))
    s = r.select("seq", F.col("j.confidence").alias("confidence"),
                 F.size("j.consensus_points").alias("n_consensus"), matched.alias("_m"))
    s = s.select("seq", "confidence", "n_consensus", F.transform("_m", one).alias("_s"))
    return s.select("seq", "confidence", "n_consensus", F.posexplode_outer("_s").alias("response_index", "x")).select(
        "seq", "confidence", "n_consensus", "response_index", F.col("x.total_score").alias("total_score"))


@query("build_score_prompt")
def q_score_prompt(spark, sf):
    """the judge's scoring prompt of every logged question, whole, with its model count."""
    raw = FX.raw_entries(spark, sf)
    p = raw.select("seq", JD.score_prompt(F.col("query"), F.col("responses")).alias("prompt"))
    return p.select("seq", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"),
                    (F.size(F.split("prompt", "\n--- Model ")) - 1).alias("n_blocks"))


@query("build_merge_prompt")
def q_merge_prompt(spark, sf):
    """the merge prompt of every logged question."""
    log = log_of(spark, sf)
    p = log.select("seq", JD.merge_prompt(F.col("query"), F.col("responses"), F.col("consensus_points"),
                                          F.col("disagreement_points")).alias("prompt"))
    return p.select("seq", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"),
                    F.col("prompt").contains(R.NONE_IDENTIFIED).alias("has_none_identified"))


@query("build_debate_prompt")
def q_debate_prompt(spark, sf):
    """debate prompts over the J4 pairing, whole."""
    from chorus.operators import pairs as PR
    d = PR.debate_pairs(log_of(spark, sf))
    p = d.select("seq", "debater", JD.debate_prompt(F.col("model_name"), F.col("own_answer"), F.col("other_answer")).alias("prompt"))
    return p.select("seq", "debater", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@query("normalize_payload")
def q_normalize(spark, sf):
    """vendor replies made from the logged answers, normalized back to one shape."""
    log = slim_log_of(spark, sf)
    ex = log.select("seq", F.length("query").alias("query_chars"), F.posexplode(LV.response_fields("model_name", "provider", "content")).alias("response_pos", "r"))
    ex = FX.with_texts(spark, sf, ex.select("seq", "query_chars", "response_pos", "r.*"), "content")
    content = F.coalesce(F.col("content"), F.lit(""))
    thought = F.concat(F.lit("Considering "), F.col("model_name"))
    qlen, clen = F.col("query_chars"), F.length(content)
    blocks = F.to_json(F.struct(
        F.array(F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), thought.alias("thinking")),
                F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("thinking"))).alias("content"),
        F.struct(qlen.alias("input_tokens"), clen.alias("output_tokens")).alias("usage")))
    choices = F.to_json(F.struct(
        F.array(F.struct(F.struct(content.alias("content"), F.lit("").alias("reasoning_content")).alias("message"))).alias("choices"),
        F.struct(qlen.alias("prompt_tokens"), clen.alias("completion_tokens")).alias("usage")))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(
        F.struct(thought.alias("text"), F.lit(True).alias("thought")),
        F.struct(F.substring(content, 1, 200).alias("text"), F.lit(False).alias("thought")),
        F.struct(F.substring(content, 201, 1 << 30).alias("text"), F.lit(False).alias("thought")),
    ).alias("parts")).alias("content"))).alias("candidates")))
    vendor = F.when(F.col("provider") == "prov_0", "blocks").when(F.col("provider") == "prov_1", "choices").otherwise("parts")
    payload = F.when(vendor == "blocks", blocks).when(vendor == "choices", choices).otherwise(parts)
    n = ex.select("seq", "response_pos", JD.normalize_payload(vendor, payload).alias("n"))
    return n.select("seq", "response_pos", "n.content", "n.reasoning_trace",
                    F.col("n.token_usage")["input"].alias("input_tokens"), F.col("n.token_usage")["output"].alias("output_tokens"))


# --- critique, verification, traces ------------------------------------------------------------------

def _parsed(spark, sf):
    return TR.parsed(FX.reviewed_turns(spark, sf))


@query("parse_critique")
def q_parse_critique(spark, sf):
    p = _parsed(spark, sf)
    return p.select("conv_id", "turn", "critique_confidence", F.size("issues").alias("n_issues"), F.array_join("issues", "|").alias("issues"))


@query("parse_verification")
def q_parse_verification(spark, sf):
    return _parsed(spark, sf).select("conv_id", "turn", "verification_confidence")


@query("needs_refinement")
def q_needs_refinement(spark, sf):
    return _parsed(spark, sf).select("conv_id", "turn", "needs_refinement")


@query("trace_rollup")
def q_trace_rollup(spark, sf):
    return TR.trace_rollup(TR.conversation_steps(FX.reviewed_turns(spark, sf)))


# --- sources and sinks ---------------------------------------------------------------------------------

@query("scan_log_json")
def q_scan_log_json(spark, sf):
    """K1 + S1: the log appended as JSON lines under the shared folder and read back with the
    explicit schema (FAILFAST)."""
    path = scratch_path(spark, "raw_log")
    IO.append_log(log_of(spark, sf), path)
    back = IO.scan_log(spark, path)
    return back.select("seq", "id", "query", "strategy", "confidence", "final_answer", "total_latency_ms",
                       F.size("responses").alias("num_responses"),
                       SC.best_response(F.col("responses"))["model_name"].alias("best_model"))


@query("result_view_roundtrip")
def q_result_view_rt(spark, sf):
    """P11 over the log stored as Parquet (the analysis copy) and read back."""
    path = scratch_path(spark, "log_parquet")
    IO.convert_log(log_of(spark, sf), path)
    return LV.result_view(IO.scan_log_parquet(spark, path)).select("seq", "response_pos", "model_name", "score", "rank")


from chorus.plans import extra_more  # noqa: E402,F401  (streaming, dispatch, models)
