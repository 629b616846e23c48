"""Asking models: fan-out dispatch, debate rounds, synthesis and reasoning traces (T-4 to T-7).

A model call is a caller-supplied Python function ``generate(model_id, prompt, system_prompt,
temperature, max_tokens) -> (content, reasoning_trace)``; it is the only per-row Python here and
runs in ``mapInPandas`` on the executors, with a per-call timeout, its exceptions turned into
error rows and its latency measured. Everything around it (fan-out, prompts, parsing, scoring,
ranking, merging) is DataFrame work. Loops of several rounds cut the lineage each round with
``checkpoint()`` into the shared ``spark.checkpoint.dir`` (reliable, survives executor loss).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import rules as R
from chorus.functions import text as TX
from chorus.operators import judge as JD
from chorus.operators import scoring as SC
from chorus.session import ensure_checkpoint_dir

Generate = Callable[[str, str, "str | None", float, int], tuple]

RESULT_SCHEMA = ("task_id long, model_id string, model_name string, provider string, content string, "
                 "reasoning_trace string, latency_ms double, error string")


def dispatch_prompts(tasks: DataFrame, generate: Generate, partitions: int | None = None,
                     timeout_s: float = 120.0, threads: int = 4) -> DataFrame:
    """T-4: one call per task row (task_id, model_id, model_name, provider, prompt, system_prompt,
    temperature, max_tokens). ``partitions`` bounds how many tasks call out at once (the
    reference's concurrency limit); each task keeps up to ``threads`` calls in flight. A call
    that raises gives an error row; one that outlives ``timeout_s`` while awaited gives a
    timeout error row."""
    df = tasks if partitions is None else tasks.repartition(partitions)

    def timed_call(row):
        t0 = time.perf_counter()
        try:
            content, trace = generate(row.model_id, row.prompt, row.system_prompt,
                                      float(row.temperature), int(row.max_tokens))
            err = None
        except Exception as ex:  # the error becomes data, as in the reference
            content, trace, err = "", None, str(ex)
        return content, trace, (time.perf_counter() - t0) * 1000.0, err

    def run(batches):
        pool = ThreadPoolExecutor(max_workers=threads)
        try:
            for pdf in batches:
                rows = list(pdf.itertuples(index=False))
                started = [(row, time.perf_counter(), pool.submit(timed_call, row)) for row in rows]
                out = []
                for row, t0, fut in started:
                    try:
                        content, trace, latency, err = fut.result(timeout=timeout_s)
                    except FutureTimeout:
                        content, trace, err = "", None, f"Timed out after {timeout_s:.0f}s"
                        latency = (time.perf_counter() - t0) * 1000.0
                    out.append((row.task_id, row.model_id, row.model_name, row.provider, content, trace, latency, err))
                yield pd.DataFrame(out, columns=["task_id", "model_id", "model_name", "provider", "content",
                                                 "reasoning_trace", "latency_ms", "error"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(run, RESULT_SCHEMA)


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fan_out_tasks(prompts: DataFrame, models: list[dict], temperature: float = 0.7, max_tokens: int = 4096) -> DataFrame:
    """J2 for dispatch: (question_id, query, system_prompt) x active models -> task rows."""
    arr = F.array(*[F.struct(*[F.lit(m[k]).alias(k) for k in ("model_id", "model_name", "provider")]) for m in models])
    t = prompts.select("question_id", "query", "system_prompt", F.posexplode(arr).alias("model_pos", "m"))
    return t.select(
        (F.col("question_id") * F.lit(len(models)) + F.col("model_pos")).alias("task_id"),
        "question_id", "model_pos", "m.model_id", "m.model_name", "m.provider",
        F.col("query").alias("prompt"), "system_prompt",
        F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))


def collect_answers(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Nest the answers of each question in model order (one shuffle, by question)."""
    j = results.join(tasks.select("task_id", "question_id", "model_pos"), "task_id")
    g = j.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(
        "model_pos", F.struct("model_id", "model_name", "provider", "content", "reasoning_trace", "latency_ms", "error").alias("r")))).alias("_a"))
    return g.select("question_id", F.transform("_a", lambda x: x["r"]).alias("responses"))


def debate_rounds(questions: DataFrame, generate: Generate, rounds: int = 2, timeout_s: float = 120.0) -> DataFrame:
    """T-5: each round, every valid answer i sees answer (i+1) mod n of the previous round and is
    asked again by the same model; a failed call keeps the old answer. Returns the valid
    answers, or the input answers (errors included) when fewer than two are valid, and
    ``debate_ms``: per round the slowest call, summed over the rounds (calls of a round run at once)."""
    cur = _checkpoint(questions.select("question_id", "query", "responses", F.lit(0.0).alias("debate_ms"),
                                       F.filter("responses", lambda r: ~SC.is_error(r)).alias("valid")))
    for _ in range(rounds):
        pairs = cur.filter(F.size("valid") >= 2).select("question_id", F.posexplode("valid").alias("i", "r"), "valid")
        n = F.size("valid")
        other = F.get(F.col("valid"), (F.col("i") + 1) % n)
        tasks = pairs.select(
            (F.shiftleft(F.col("question_id").cast("long"), 20) + F.col("i")).alias("task_id"), "question_id", "i",
            F.col("r.model_id").alias("model_id"), F.col("r.model_name").alias("model_name"), F.col("r.provider").alias("provider"),
            JD.debate_prompt(F.col("r.model_name"), F.col("r.content"), other["content"]).alias("prompt"),
            F.lit(None).cast("string").alias("system_prompt"), F.lit(0.7).alias("temperature"), F.lit(4096).alias("max_tokens"),
            F.col("r").alias("old"))
        res = dispatch_prompts(tasks.drop("old"), generate, timeout_s=timeout_s)
        upd = tasks.select("task_id", "question_id", "i", "old").join(res, "task_id")
        fresh = F.struct("model_id", "model_name", "provider", "content", "reasoning_trace", "latency_ms", "error")
        kept = F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("old")).otherwise(fresh)
        upd = upd.select("question_id", "i", kept.alias("r"), F.coalesce("latency_ms", F.lit(0.0)).alias("call_ms"))
        nested = upd.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("_v"), F.max("call_ms").alias("_ms")).select(
            "question_id", F.transform("_v", lambda x: x["r"]).alias("_new"), "_ms")
        cur = cur.join(nested, "question_id", "left").select(
            "question_id", "query", "responses", (F.col("debate_ms") + F.coalesce("_ms", F.lit(0.0))).alias("debate_ms"),
            F.coalesce("_new", "valid").alias("valid"))
        cur = _checkpoint(cur)
    return cur.select("question_id", "query", F.when(F.size("valid") >= 2, F.col("valid")).otherwise(F.col("responses")).alias("responses"), "debate_ms")


def _judge_tasks(df: DataFrame, prompt_col, judge: dict, task_offset: int) -> DataFrame:
    return df.select(
        (F.col("question_id") + F.lit(task_offset)).alias("task_id"), "question_id",
        F.lit(judge["model_id"]).alias("model_id"), F.lit("judge").alias("model_name"), F.lit(judge["provider"]).alias("provider"),
        prompt_col.alias("prompt"), F.lit("You are a precise evaluator. Reply in JSON when asked.").alias("system_prompt"),
        F.lit(0.3).alias("temperature"), F.lit(8192).alias("max_tokens"))


def synthesize(questions: DataFrame, generate: Generate, judge: dict, debate: int = 2, timeout_s: float = 120.0) -> DataFrame:
    """T-6: per question (question_id, query, strategy, responses): debate first when asked,
    then score with the judge, then best-of-n / merge / merge + verify; returns raw records.
    The record's total latency is that of the original answers plus the whole synthesis: debate,
    scoring, merging and verification calls."""
    # the input is read by several branches; pin it once (it may hold measured latencies)
    q = _checkpoint(questions.withColumn("strategy", F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY))))
    deb = q.filter(F.col("strategy") == "debate")
    own = ("question_id", "query", "strategy", "responses", "original", "debate_ms")
    first = deb.select("question_id", "strategy", F.col("responses").alias("original"))
    if debate:
        deb = debate_rounds(deb.select("question_id", "query", "responses"), generate, debate, timeout_s).join(first, "question_id")
    else:
        deb = deb.withColumn("original", F.col("responses")).withColumn("debate_ms", F.lit(0.0))
    plain = q.filter(F.col("strategy") != "debate").withColumn("original", F.col("responses")).withColumn("debate_ms", F.lit(0.0))
    work = plain.select(*own).unionByName(deb.select(*own))
    work = _checkpoint(work)
    scored_t = _judge_tasks(work, JD.score_prompt(F.col("query"), F.col("responses")), judge, 0)
    replies = dispatch_prompts(scored_t, generate, timeout_s=timeout_s).select(
        F.col("task_id").alias("question_id"), F.col("content").alias("judge_text"), F.col("latency_ms").alias("_t_score"))
    w = work.join(replies, "question_id").withColumn("judge", JD.parse_judge_reply(F.col("judge_text")))
    w = SC.score_entries(w)
    w = _checkpoint(w)
    merged_t = _judge_tasks(w.filter(F.col("strategy") != "best_of_n"),
                            JD.merge_prompt(F.col("query"), F.col("ranked"), F.col("judge.consensus_points"),
                                            F.col("judge.disagreement_points")), judge, 0)
    merged = dispatch_prompts(merged_t, generate, timeout_s=timeout_s).select(
        F.col("task_id").alias("question_id"), F.col("content").alias("merged"), F.col("latency_ms").alias("_t_merge"))
    w = _checkpoint(w.join(merged, "question_id", "left"))
    ver_t = _judge_tasks(w.filter(F.col("strategy") == "chain_of_verification"), JD.verify_prompt(F.col("query"), F.col("merged")), judge, 0)
    verified = dispatch_prompts(ver_t, generate, timeout_s=timeout_s).select(
        F.col("task_id").alias("question_id"), F.col("content").alias("verified"), F.col("latency_ms").alias("_t_verify"))
    w = _checkpoint(w.join(verified, "question_id", "left"))
    final = (F.when(F.col("strategy") == "best_of_n", SC.best_of_n(F.col("ranked")))
             .when(F.col("strategy") == "chain_of_verification", F.col("verified")).otherwise(F.col("merged")))
    rec = w.select(F.col("question_id").alias("seq"), F.col("question_id").cast("string").alias("id"),
                   F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
                   "query", "strategy", final.alias("final_answer"), "judge",
                   # synthesis time: debate, and the judge's scoring, merging and verification calls
                   (F.col("debate_ms") + F.col("_t_score") + F.coalesce("_t_merge", F.lit(0.0)) + F.coalesce("_t_verify", F.lit(0.0))).alias("judge_ms"),
                   F.col("original").alias("responses"), "ranked")
    return SC.to_raw_record(rec)


def reasoning_trace(questions: DataFrame, generate: Generate, model: dict, max_refinements: int = 2,
                    timeout_s: float = 120.0) -> DataFrame:
    """T-7: decompose, reason, critique, verify, then up to ``max_refinements`` refinements for the
    questions that still need one (F18); the last refinement is not re-verified. Returns the
    trace steps (query_id, step_no, stage, output_text, confidence, issues_found)."""

    def ask(df, prompt_col, stage):
        t = df.select(F.col("query_id").alias("task_id"), F.lit(model["model_id"]).alias("model_id"),
                      F.lit(model["model_name"]).alias("model_name"), F.lit(model["provider"]).alias("provider"),
                      prompt_col.alias("prompt"), F.lit(stage).alias("system_prompt"),
                      F.lit(0.4).alias("temperature"), F.lit(4096).alias("max_tokens"))
        return dispatch_prompts(t, generate, timeout_s=timeout_s).select(F.col("task_id").alias("query_id"), F.col("content").alias(stage))

    q = _checkpoint(questions.select("query_id", "query"))
    s = _checkpoint(q.join(ask(q, F.concat(F.lit("Decompose: "), F.col("query")), "decompose"), "query_id"))
    s = _checkpoint(s.join(ask(s, F.concat(F.lit("Reason: "), F.col("query"), F.lit("\n"), F.col("decompose")), "reason"), "query_id"))
    s = _checkpoint(s.join(ask(s, F.concat(F.lit("Critique: "), F.col("reason")), "critique"), "query_id"))
    s = _checkpoint(s.join(ask(s, F.concat(F.lit("Verify: "), F.col("reason"), F.lit("\n"), F.col("critique")), "verify"), "query_id"))
    c = TX.parse_critique(F.col("critique"))
    s = s.select("*", c["confidence"].alias("c_conf"), c["issues"].alias("issues"), TX.parse_verification(F.col("verify")).alias("v_conf"))
    step = lambda no, stage, out, conf, issues=None: F.struct(
        F.lit(no).cast("int").alias("step_no"), F.lit(stage).alias("stage"), out.alias("output_text"),
        conf.cast("double").alias("confidence"), (issues if issues is not None else F.array().cast("array<string>")).alias("issues_found"))
    steps = s.select("query_id", F.array(
        step(1, "decompose", F.col("decompose"), F.lit(None)), step(2, "reason", F.col("reason"), F.lit(None)),
        step(3, "critique", F.col("critique"), F.col("c_conf"), F.col("issues")), step(4, "verify", F.col("verify"), F.col("v_conf"))).alias("steps"),
        F.col("reason").alias("answer"), "c_conf", "issues", "v_conf", "critique", "verify")
    steps = _checkpoint(steps)
    no = 5
    for i in range(max_refinements):
        open_ = steps.filter(TX.needs_refinement(F.col("v_conf"), F.col("issues")))
        ref = ask(open_, F.concat(F.lit("Refine: "), F.col("answer"), F.lit("\n"), F.col("critique"), F.lit("\n"), F.col("verify")), "refine")
        upd = _checkpoint(open_.join(ref, "query_id").select("query_id", "steps", F.col("refine").alias("answer")))
        new_steps = F.array(step(no, "refine", F.col("answer"), F.lit(None)))
        if i < max_refinements - 1:
            upd = _checkpoint(upd.join(ask(upd, F.concat(F.lit("Critique: "), F.col("answer")), "critique"), "query_id"))
            upd = _checkpoint(upd.join(ask(upd, F.concat(F.lit("Verify: "), F.col("answer"), F.lit("\n"), F.col("critique")), "verify"), "query_id"))
            c = TX.parse_critique(F.col("critique"))
            upd = upd.select("*", c["confidence"].alias("c_conf"), c["issues"].alias("issues"),
                             TX.parse_verification(F.col("verify")).alias("v_conf"))
            new_steps = F.array(step(no, "refine", F.col("answer"), F.lit(None)),
                                step(no + 1, "critique", F.col("critique"), F.col("c_conf"), F.col("issues")),
                                step(no + 2, "verify", F.col("verify"), F.col("v_conf")))
        else:
            upd = upd.select("*", F.lit(None).cast("double").alias("c_conf"), F.lit(None).cast("array<string>").alias("issues"),
                             F.lit(None).cast("double").alias("v_conf"), F.lit(None).cast("string").alias("critique"),
                             F.lit(None).cast("string").alias("verify"))
        upd = upd.select("query_id", F.concat("steps", new_steps).alias("steps"), "answer", "c_conf", "issues", "v_conf", "critique", "verify")
        closed = steps.join(open_.select("query_id"), "query_id", "left_anti")
        steps = _checkpoint(closed.unionByName(upd))
        no += 3
    return steps.select("query_id", F.explode("steps").alias("s")).select("query_id", "s.*")
