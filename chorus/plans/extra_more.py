"""Named queries for streaming, sinks round trips, dispatch with a stand-in model, and learned
scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.operators import collect as COL
from chorus.operators import ids as ID
from chorus.operators import logview as LV
from chorus.operators import nearest as NN
from chorus.operators import pairs as PR
from chorus.operators import prepare as PP
from chorus.operators import reward as RW
from chorus.operators import router_store as RS
from chorus.operators import routing as RT
from chorus.operators import vectors as VC
from chorus.plans import ml as ML
from chorus.plans import projection as PJ
from chorus.plans.extra import scratch_path
from chorus.plans.registry import _loaded, _pairs, _pref, answered_log_of, log_of, query, slim_log_of
from chorus.sources import io as IO
from chorus.sources.tables import read_table
from chorus.streaming import stats as ST


def _log_folder(spark, sf) -> str:
    """The log written as JSON files (the stream's input folder), each task's rows as one: the whole log moves to no other task. Compressed,
    as it is mostly prose."""
    path = scratch_path(spark, "stream_in")
    log_of(spark, sf).write.option("compression", "gzip").json(path)
    return path


# --- streaming ---------------------------------------------------------------------------------

@query("stream_training_pairs")
def q_stream_pairs(spark, sf):
    """T-1 + T-2: pairs extracted by a stream over the log folder (one file per micro-batch)."""
    src = _log_folder(spark, sf)
    out = ST.run_training_pairs(spark, src, scratch_path(spark, "stream_pairs"), scratch_path(spark, "ckpt_pairs"))
    return out.select("seq", "id", "instruction", "output", "metadata.*")


@query("stream_stats")
def q_stream_stats(spark, sf):
    """T-3: running statistics by (kind, key) after the stream drained the folder."""
    src = _log_folder(spark, sf)
    return ST.run_stats(spark, src, scratch_path(spark, "stream_stats"), scratch_path(spark, "ckpt_stats"))


@query("stats_snapshot")
def q_stats_snapshot(spark, sf):
    """A6-A10 + K3 + S5: the stats snapshot written, read back, its count maps as rows."""
    path = scratch_path(spark, "stats")
    IO.write_stats(COL.stats_snapshot(answered_log_of(spark, sf)), path)
    st = IO.read_stats(spark, path)
    rows = [st.select(F.lit(k).alias("kind"), F.explode(m).alias("key", "n")) for k, m in
            (("strategy", "strategy_counts"), ("model", "model_counts"), ("win", "model_wins"))]
    tot = st.select(F.lit("total").alias("kind"), F.explode(F.map_from_arrays(
        F.array(F.lit("queries"), F.lit("responses"), F.lit("training_pairs")),
        F.array(F.col("total_queries"), F.col("total_responses"), F.col("training_pairs")))).alias("key", "n"))
    out = tot
    for r in rows:
        out = out.unionByName(r)
    return out.select("kind", "key", F.col("n").cast("long").alias("n"))


# --- sink / source round trips -----------------------------------------------------------------

@query("scan_training_pairs")
def q_scan_pairs(spark, sf):
    """K1 + S2: training pairs written as JSON lines and read back with the explicit schema."""
    path = scratch_path(spark, "pairs")
    _pairs(spark, sf).drop("seq").write.json(path)
    back = IO.scan_training_pairs(spark, path)
    return back.select(F.col("id").cast("long").alias("seq"), "id", "instruction", "output", "metadata.*")


@query("write_train_val")
def q_write_train_val(spark, sf):
    """W11 + K7 + S3: the seeded split written one folder per split and read back."""
    path = scratch_path(spark, "prepared")
    split = PP.shuffle_split(PP.to_alpaca(_loaded(spark, sf)))
    IO.write_train_val(split, path)
    back = IO.scan_prepared(spark, path, "seq long, instruction string, input string, output string, system string")
    return PP.split_counts(back)


@query("write_reward_set")
def q_write_reward(spark, sf):
    """K8: both chats and the margin written as JSON lines and read back."""
    path = scratch_path(spark, "reward")
    m = PR.margin(_pref(spark, sf))
    IO.write_reward_set(m, path)
    turns = "array<struct<role:string,content:string>>"
    back = spark.read.schema(f"seq long, pair_no int, chosen_messages {turns}, rejected_messages {turns}, margin double").json(path)
    return PR.with_turns(back)


@query("write_router_perf")
def q_router_perf(spark, sf):
    """K4 + S6: the router's performance table saved, then used from the saved copy."""
    path = scratch_path(spark, "router_perf")
    log = slim_log_of(spark, sf)
    perf = RT.load_or_build_performance(spark, log, path)
    return perf.select("question_type", "best_strategy", "type_count",
                       F.size("ranked_models").alias("n_models"), F.get("ranked_models", 0)["model_name"].alias("best_model"))


@query("refresh_router_perf")
def q_refresh_router_perf(spark, sf):
    """K4: the table refreshed after each of two appends to the stored log."""
    path, store = scratch_path(spark, "router_log"), scratch_path(spark, "router_store")
    log = log_of(spark, sf)
    for part in (F.col("seq") % 3 == 0, F.col("seq") % 3 != 0):
        log.where(part).write.mode("append").option("compression", "zstd").parquet(path)      # mostly prose, which snappy holds badly
        RS.refresh(spark, path, store)
    return RS.performance(spark, store).select("question_type", "best_strategy", "type_count",
                                               F.size("ranked_models").alias("n_models"), F.get("ranked_models", 0)["model_name"].alias("best_model"))


# --- learned scorers (rows-only checks) ----------------------------------------------

@query("quality_regressor")
def q_quality_regressor(spark, sf):
    pred = ML.quality_regressor(ML.embedding_features(read_table(spark, sf, "embeddings")))
    return pred.select("vec_id", *[f"pred_{n}" for n in ML.DIMS])


@query("quality_report")
def q_quality_report(spark, sf):
    """M1: held-out error per dimension beside a constant predictor's."""
    return ML.quality_report(ML.embedding_features(read_table(spark, sf, "embeddings")))


@query("grounding_report")
def q_grounding_report(spark, sf):
    """M4: held-out accuracy beside the larger class."""
    return ML.grounding_report(VC.triples(read_table(spark, sf, "embeddings")))


@query("difficulty_classifier")
def q_difficulty_classifier(spark, sf):
    p = ML.difficulty_classifier(slim_log_of(spark, sf).select("seq", "query"))
    return p.select("seq", "predicted_difficulty")


@query("strategy_classifier")
def q_strategy_classifier(spark, sf):
    log = slim_log_of(spark, sf)
    best = RT.best_strategy(RT.strategy_perf(log))
    return ML.strategy_classifier(log.select("seq", "query"), best).select("seq", "predicted_strategy")


@query("grounding_classifier")
def q_grounding(spark, sf):
    g = ML.grounding_classifier(VC.triples(read_table(spark, sf, "embeddings")))
    return g.select("triple", "label", "hallucination_probability")


@query("is_grounded")
def q_is_grounded(spark, sf):
    g = ML.grounding_classifier(VC.triples(read_table(spark, sf, "embeddings")))
    return g.select("triple", "label", "is_grounded")


@query("embedding_evaluate")
def q_embedding_evaluate(spark, sf):
    return ML.embedding_evaluate(read_table(spark, sf, "embeddings"))


_REWARD_MODELS: dict = {}       # (application, folder) to the pinned differences and the path of the stored weights


def _reward_model(spark, sf):
    """The stored differences and weights of one folder's log, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REWARD_MODELS:
        rows = RW.pair_rows(PR.preference_pairs(log_of(spark, sf)).select("seq", "chosen", "rejected"))
        _REWARD_MODELS[key] = (rows, RW.save(spark, RW.fit(rows)))
    rows, path = _REWARD_MODELS[key]
    return rows, RW.load(spark, path)


def _rewards(spark, sf):
    log = log_of(spark, sf)
    _, weights = _reward_model(spark, sf)
    # the valid answers with their texts: one explode of the needed fields, no join
    from chorus.operators.scoring import is_valid
    ex = log.select("seq", F.posexplode(LV.response_fields("model_name", "content", "error", "total_score", "rank"))
                    .alias("response_pos", "r"))
    answers = ex.filter(is_valid(F.col("r"))).select("seq", "response_pos", "r.model_name", "r.content", "r.total_score", "r.rank")
    return RW.rewards(answers, weights)


@query("reward_report")
def q_reward_report(spark, sf):
    """M5: pairs learned from and held out, and the share of held-out pairs that the model orders rightly."""
    return RW.report(*_reward_model(spark, sf))


@query("reward_model")
def q_reward_model(spark, sf):
    return _rewards(spark, sf).select("seq", "response_pos", "reward")


@query("best_of_n_by_reward")
def q_best_by_reward(spark, sf):
    return ML.best_of_n_by_reward(_rewards(spark, sf)).select("seq", "response_pos", "model_name", "reward")


@query("rejection_filter")
def q_rejection(spark, sf):
    return ML.rejection_filter(_rewards(spark, sf).select("seq", "response_pos", "reward"))


def _losses(spark, sf):
    return ML.batch_losses(VC.triples(read_table(spark, sf, "embeddings")))


def _trained(spark, sf):
    return PJ.train(spark, VC.triples(read_table(spark, sf, "embeddings")), scratch_path(spark, "projection"))


@query("trained_epoch_means")
def q_trained_epochs(spark, sf):
    """A20 over a real training run: mean losses of each epoch of the projection."""
    return ML.epoch_means(_trained(spark, sf))


@query("trained_best_epoch")
def q_trained_best(spark, sf):
    """A21 over a real training run."""
    return ML.best_epoch(ML.epoch_means(_trained(spark, sf)))


@query("epoch_means")
def q_epoch_means(spark, sf):
    return ML.epoch_means(_losses(spark, sf))


@query("best_epoch")
def q_best_epoch(spark, sf):
    return ML.best_epoch(ML.epoch_means(_losses(spark, sf)))



# --- remaining inventory rows ------------------------------------------------------------------

@query("shuffle_split")
def q_shuffle_split(spark, sf):
    """The seeded train/validation assignment of every loaded pair."""
    return PP.shuffle_split(_loaded(spark, sf)).select("seq", "split")


@query("short_id")
def q_short_id(spark, sf):
    """a stable id per logged question, from its text and time."""
    log = slim_log_of(spark, sf).select("seq", "query", "timestamp")
    return ID.stable_ids(log, F.concat("query", "timestamp")).select("seq", "short_id")


@query("build_verify_prompt")
def q_verify_prompt(spark, sf):
    """the verification prompt of every final answer, whole."""
    from chorus.operators import judge as JD
    p = answered_log_of(spark, sf).select("seq", JD.verify_prompt(F.col("query"), F.col("final_answer")).alias("prompt"))
    return p.select("seq", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@query("file_size_mb")
def q_file_size(spark, sf):
    """size of the raw log written as JSON lines, in MB (2 decimals)."""
    path = scratch_path(spark, "size_log")
    IO.append_log(log_of(spark, sf), path)
    return IO.file_size_mb(spark, path)


@query("to_raw_record")
def q_to_raw_record(spark, sf):
    """K2: the raw records the collector writes (entry fields of the nested record)."""
    from chorus.plans.registry import REGISTRY
    return REGISTRY["scan_log"](spark, sf)


@query("scan_prepared")
def q_scan_prepared(spark, sf):
    """S3: prepared train/validation sets read back, tagged by split (sizes per split)."""
    from chorus.plans.registry import REGISTRY
    return REGISTRY["write_train_val"](spark, sf)


@query("read_stats")
def q_read_stats(spark, sf):
    """S5 + K3: the stats snapshot written and read back (count maps as rows)."""
    from chorus.plans.registry import REGISTRY
    return REGISTRY["stats_snapshot"](spark, sf)


@query("stream_log_source")
def q_stream_source(spark, sf):
    """T-1: the log folder read as a stream (one file per micro-batch) into a Parquet sink."""
    src = _log_folder(spark, sf)
    out, ck = scratch_path(spark, "stream_raw"), scratch_path(spark, "ckpt_raw")
    s = ST.stream_log_source(spark, src).select("seq", "id", "query", "strategy", "confidence",
                                                LV.n_responses().alias("num_responses"))
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("nearest_answers")
def q_nearest(spark, sf):
    """W8's candidates: the ten nearest of all vectors for every vector whose id 20 divides."""
    return NN.nearest(read_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)
