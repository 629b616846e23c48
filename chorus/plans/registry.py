"""Named queries: each callable takes (spark, sf_dir) and returns a DataFrame.

Inputs come from the driver's tables: the ensemble log is built from orders, lineitem and
documents by ``sources.fixtures`` (rows only) and then scored, ranked and recorded by the
library. Nested results (arrays of structs) are returned flat (one row per element, or lists
joined with a separator) so that every engine can compare them value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.functions import rules as R
from chorus.functions import text as TX
from chorus.operators import catalog as CAT
from chorus.operators import collect as COL
from chorus.operators import logview as LV
from chorus.operators import pairs as PR
from chorus.operators import prepare as PP
from chorus.operators import routing as RT
from chorus.operators import scoring as SC
from chorus.operators import vectors as VC
from chorus.operators import weakness as WK
from chorus.sources import fixtures as FX
from chorus.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def log_of(spark, sf_dir) -> DataFrame:
    return FX.ensemble_log(spark, sf_dir)


def slim_log_of(spark, sf_dir) -> DataFrame:
    """The log with references in place of the answers' texts, for queries that need no text or only a few (``FX.with_texts``)."""
    return FX.ensemble_log(spark, sf_dir, refs=True)


def answered_log_of(spark, sf_dir) -> DataFrame:
    """The log with whole final answers, and references in place of the single answers' texts."""
    return FX.with_texts(spark, sf_dir, slim_log_of(spark, sf_dir), "final_answer")


def _joined(col, sep=","):
    return F.array_join(col, sep)


# --- scans and log views -----------------------------------------------------------------------

@query("scan_log")
def q_scan_log(spark, sf):
    """S1 view: the entry-level fields of every raw record as the collector builds it (the read
    of the JSON lines with the explicit schema is ``scan_log_json``)."""
    log = answered_log_of(spark, sf)
    return log.select("seq", "id", "timestamp", "query", "strategy", "confidence", "final_answer", "reasoning",
                      F.size("consensus_points").alias("n_consensus"), F.size("disagreement_points").alias("n_disagreements"),
                      "total_latency_ms", LV.n_responses().alias("num_responses"))


@query("explode_responses")
def q_explode(spark, sf):
    """One row per answer; questions without answers keep one row of nulls."""
    ex = LV.explode_responses(slim_log_of(spark, sf), keep=("seq",))
    ex = ex.select("seq", "response_pos", "model_id", "model_name", "provider", "content", "latency_ms", "error",
                   "total_score", "rank")
    return FX.with_texts(spark, sf, ex, "content")


@query("valid_responses")
def q_valid(spark, sf):
    return LV.valid_responses(slim_log_of(spark, sf))


@query("non_error_responses")
def q_non_error(spark, sf):
    return LV.non_error_responses(slim_log_of(spark, sf), lambda df: FX.with_texts(spark, sf, df, "content"))


@query("recent_view")
def q_recent_view(spark, sf):
    return LV.recent_view(slim_log_of(spark, sf))


@query("recent_entries")
def q_recent(spark, sf):
    """The 20 most recent entries (the service's n)."""
    return LV.recent_entries(slim_log_of(spark, sf), 20)


@query("result_view")
def q_result_view(spark, sf):
    return FX.with_texts(spark, sf, LV.result_view(slim_log_of(spark, sf)), "content")


@query("response_preview")
def q_preview(spark, sf):
    return LV.response_preview(slim_log_of(spark, sf), lambda df: FX.with_texts(spark, sf, df, "content"))


@query("result_summary")
def q_summary(spark, sf):
    return LV.result_summary(slim_log_of(spark, sf))


# --- scoring -----------------------------------------------------------------------------------

@query("attach_scores")
def q_attach(spark, sf):
    """J1 + A1 on the raw answers, in their original order."""
    raw = FX.raw_entries(spark, sf, refs=True)
    matched, one = SC.attach_scores(F.col("responses"), F.col("judge.scores"))
    s = raw.select("seq", matched.alias("_m")).select("seq", F.transform("_m", one).alias("_s"))
    ex = s.select("seq", F.explode("_s").alias("r"))
    return ex.select("seq", "r.response_index", "r.model_name",
                     *[F.col("r.scores")[n].alias(n) for n, _ in R.SCORE_WEIGHTS], "r.total_score")


@query("weighted_total")
def q_weighted_total(spark, sf):
    """A1 recomputed from each stored scores map."""
    ex = LV.explode_responses(slim_log_of(spark, sf), outer=False, keep=("seq",))
    return ex.select("seq", "response_pos", SC.total_from_map("scores").alias("weighted_total"))


@query("rank_responses")
def q_rank(spark, sf):
    """Ranks of the scored answers of every question."""
    scored = SC.score_entries(FX.raw_entries(spark, sf, refs=True))
    ex = scored.select("seq", F.explode("ranked").alias("r"))
    return ex.select("seq", "r.rank", "r.model_name", "r.total_score", "r.error")


@query("best_of_n")
def q_best_of_n(spark, sf):
    best = slim_log_of(spark, sf).select("seq", SC.best_of_n(F.col("responses")).alias("best_of_n"))
    return FX.with_texts(spark, sf, best, "best_of_n")


@query("best_response")
def q_best_response(spark, sf):
    b = SC.best_response(F.col("responses"))
    return slim_log_of(spark, sf).select("seq", b["model_name"].alias("best_model"), b["total_score"].alias("best_score"))


@query("total_latency")
def q_total_latency(spark, sf):
    return slim_log_of(spark, sf).select("seq", "total_latency_ms")


# --- text rules ----------------------------------------------------------------------------------

@query("classify_question")
def q_classify(spark, sf):
    return slim_log_of(spark, sf).select("seq", TX.classify_question("query").alias("question_type"))


@query("estimate_difficulty")
def q_difficulty(spark, sf):
    return slim_log_of(spark, sf).select("seq", TX.estimate_difficulty("query").alias("difficulty"))


@query("categorize_query")
def q_categorize(spark, sf):
    return slim_log_of(spark, sf).select("seq", _joined(TX.categorize_query("query")).alias("categories"))


# --- routing -------------------------------------------------------------------------------------

@query("model_perf")
def q_model_perf(spark, sf):
    return RT.model_perf(slim_log_of(spark, sf)).drop("first_seen")


@query("strategy_perf")
def q_strategy_perf(spark, sf):
    return RT.strategy_perf(slim_log_of(spark, sf)).drop("first_seen")


@query("type_counts")
def q_type_counts(spark, sf):
    return RT.type_counts(slim_log_of(spark, sf))


@query("top_models_by_type")
def q_top_models(spark, sf):
    return RT.top_models_by_type(RT.model_perf(slim_log_of(spark, sf))).select("question_type", "model_name", "model_rank", "avg_score")


@query("best_strategy")
def q_best_strategy(spark, sf):
    return RT.best_strategy(RT.strategy_perf(slim_log_of(spark, sf))).select(
        "question_type", F.col("strategy").alias("best_strategy"), "avg_confidence")


def _routed(spark, sf):
    log = slim_log_of(spark, sf)
    return RT.route(log.select("seq", "query"), RT.performance_by_type(log))


@query("route")
def q_route(spark, sf):
    """route every question of the log against the log's own performance table."""
    r = _routed(spark, sf)
    return r.select("seq", "question_type", "difficulty", _joined(F.col("recommended_models")).alias("recommended_models"),
                    "recommended_strategy", "temperature", "use_meta_reasoning", "reasoning_depth", "confidence", "explanation")


@query("route_temperature")
def q_route_temperature(spark, sf):
    return _routed(spark, sf).select("seq", "temperature")


@query("route_depth")
def q_route_depth(spark, sf):
    return _routed(spark, sf).select("seq", "reasoning_depth")


@query("route_confidence")
def q_route_confidence(spark, sf):
    return _routed(spark, sf).select("seq", "confidence")


@query("use_meta_reasoning")
def q_use_meta(spark, sf):
    return _routed(spark, sf).select("seq", "use_meta_reasoning")


@query("route_explanation")
def q_route_expl(spark, sf):
    return _routed(spark, sf).select("seq", "explanation")


@query("perf_lookup")
def q_perf_lookup(spark, sf):
    log = slim_log_of(spark, sf)
    j = RT.perf_lookup(log.select("seq", "query"), RT.performance_by_type(log))
    top = F.get(F.coalesce("ranked_models", F.array()), 0)
    return j.select("seq", "question_type", F.coalesce(F.size("ranked_models"), F.lit(0)).alias("n_models"),
                    top["model_name"].alias("best_model"), top["avg_score"].alias("best_avg"),
                    "best_strategy", F.coalesce("type_count", F.lit(0)).alias("type_count"))


# --- collection ----------------------------------------------------------------------------------

@query("training_pair_filter")
def q_pair_filter(spark, sf):
    return COL.training_pair_filter(answered_log_of(spark, sf)).select("seq")


def _pairs(spark, sf):
    return COL.training_pairs(answered_log_of(spark, sf))


@query("training_pairs")
def q_training_pairs(spark, sf):
    return _pairs(spark, sf).select("seq", "id", "instruction", "output", "metadata.*")


@query("training_stats")
def q_training_stats(spark, sf):
    return COL.training_stats(answered_log_of(spark, sf))


@query("strategy_counts")
def q_strategy_counts(spark, sf):
    return COL.strategy_counts(slim_log_of(spark, sf))


@query("model_counts")
def q_model_counts(spark, sf):
    return COL.model_counts(slim_log_of(spark, sf))


@query("model_wins")
def q_model_wins(spark, sf):
    return COL.model_wins(slim_log_of(spark, sf))


@query("training_readiness")
def q_readiness(spark, sf):
    return COL.training_readiness(answered_log_of(spark, sf))


@query("export_chat_log")
def q_export_chat(spark, sf):
    """K5: one row per chat turn of the exported pairs."""
    ex = COL.export_chat_log(_pairs(spark, sf))
    return COL.explode_turns(ex, "conversations")


# --- weakness ------------------------------------------------------------------------------------

@query("category_stats")
def q_category_stats(spark, sf):
    return WK.category_stats(slim_log_of(spark, sf)).select(
        "category", "count", "disagreement_rate", "low_confidence_rate", "avg_score", "n_scores")


@query("category_model_avg")
def q_category_model_avg(spark, sf):
    return WK.category_model_avg(slim_log_of(spark, sf)).drop("first_seen")


def _patterns(spark, sf):
    return WK.weakness_patterns(slim_log_of(spark, sf))


@query("weakness_patterns")
def q_patterns(spark, sf):
    p = _patterns(spark, sf)
    return p.select("category", "description", "severity", _joined(F.col("affected_models")).alias("affected_models"),
                    _joined(F.col("example_queries"), "\n").alias("example_queries"), "avg_score", "disagreement_rate", "count")


@query("weak_models")
def q_weak_models(spark, sf):
    """Affected models of every reported category (weak ones, or all when none is weak)."""
    return _patterns(spark, sf).select("category", F.posexplode("affected_models").alias("model_pos", "model_name"))


@query("severity")
def q_severity(spark, sf):
    return _patterns(spark, sf).select("category", "severity")


@query("severity_order")
def q_severity_order(spark, sf):
    """Position of each category in the report (severity desc, first seen on ties)."""
    from pyspark.sql import Window
    p = _patterns(spark, sf)
    return p.select("category", F.row_number().over(Window.orderBy(F.col("severity").desc(), F.col("first_seen"))).alias("position"))


@query("first_k_examples")
def q_first_k(spark, sf):
    ex = WK.first_k_examples(slim_log_of(spark, sf))
    return ex.select("category", F.posexplode("example_queries").alias("example_no", "query"))


@query("describe_weakness")
def q_describe(spark, sf):
    return _patterns(spark, sf).select("category", "description")


@query("top_weak_models")
def q_top_weak(spark, sf):
    """The first three weak models of each category (the description's list)."""
    log = slim_log_of(spark, sf)
    cs = WK.category_stats(log).filter(F.col("count") >= R.MIN_CATEGORY_ENTRIES)
    cm = WK.category_model_avg(log).join(F.broadcast(cs.select("category", F.col("avg_score").alias("cat_avg"))), "category")
    weak = cm.filter(F.col("avg_score") < F.col("cat_avg") * R.WEAK_MODEL_FACTOR)
    g = weak.groupBy("category").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("first_seen", "model_name"))),
                                                         lambda x: x["model_name"]), 1, R.DESCRIPTION_WEAK_MODELS).alias("m"))
    return g.select("category", F.posexplode("m").alias("model_pos", "model_name"))


@query("weakness_report_entries")
def q_report_entries(spark, sf):
    """A16 entries (lists joined for comparison)."""
    r = WK.weakness_report_entries(slim_log_of(spark, sf))
    return r.select("category", "severity", "avg_score", "disagreement_rate", "example_count",
                    _joined(F.col("affected_models")).alias("affected_models"),
                    _joined(F.col("sample_queries"), "\n").alias("sample_queries"))


@query("weakness_report")
def q_report(spark, sf):
    return WK.weakness_report(slim_log_of(spark, sf))


def _adversarial(spark, sf):
    return WK.adversarial_examples(slim_log_of(spark, sf))


@query("adversarial_examples")
def q_adversarial(spark, sf):
    a = _adversarial(spark, sf)
    return a.select("seq", "weakness_category", "target_score_improvement",
                    F.size("failed_model_answers").alias("num_failed"))


@query("weak_category_match")
def q_weak_match(spark, sf):
    return _adversarial(spark, sf).select("seq", "weakness_category")


@query("adversarial_eligible")
def q_adv_eligible(spark, sf):
    return WK.adversarial_eligible(slim_log_of(spark, sf)).select("seq")


@query("failed_responses")
def q_failed(spark, sf):
    log = slim_log_of(spark, sf)
    ex = log.select("seq", F.posexplode(WK.failed_responses(F.col("responses"))).alias("failed_no", "f"))
    ex = FX.with_texts(spark, sf, ex.select("seq", "failed_no", "f.model", "f.score", "f.answer_preview"), "answer_preview")
    # a reference is shorter than a preview; its text is cut here
    return ex.withColumn("answer_preview", F.substring("answer_preview", 1, R.FAILED_PREVIEW_CHARS))


@query("export_adversarial")
def q_export_adv(spark, sf):
    ex = WK.export_adversarial(FX.with_texts(spark, sf, _adversarial(spark, sf), "best_answer"))
    turns = COL.explode_turns(ex, "messages").filter(F.col("role") != "system")
    return turns


# --- pairs -----------------------------------------------------------------------------------------

def _pref(spark, sf):
    return FX.with_texts(spark, sf, PR.preference_pairs(slim_log_of(spark, sf)), "chosen", "rejected")


PAIR_COLS = ["seq", "pair_no", "pair_kind", "chosen_model", "rejected_model", "chosen_score", "rejected_score",
             "chosen", "rejected"]


@query("preference_pairs")
def q_pref(spark, sf):
    return _pref(spark, sf).select(*PAIR_COLS)


@query("best_vs_worst")
def q_bvw(spark, sf):
    return FX.with_texts(spark, sf, PR.best_vs_worst(slim_log_of(spark, sf)).select(*PAIR_COLS), "chosen", "rejected")


@query("adjacent_pairs")
def q_adjacent(spark, sf):
    return FX.with_texts(spark, sf, PR.adjacent_pairs(slim_log_of(spark, sf)).select(*PAIR_COLS), "chosen", "rejected")


@query("margin")
def q_margin(spark, sf):
    return PR.with_turns(PR.margin(_pref(spark, sf)))


@query("triplets")
def q_triplets(spark, sf):
    t = PR.triplets(slim_log_of(spark, sf)).select("seq", "triplet_no", "good_model", "bad_model", "good_score",
                                                   "bad_score", "good_answer", "bad_answer")
    return FX.with_texts(spark, sf, t, "good_answer", "bad_answer")


@query("debate_pairs")
def q_debate(spark, sf):
    return PR.debate_pairs(slim_log_of(spark, sf)).select("seq", "debater", "model_name", "other_model_name")


# --- dataset preparation -----------------------------------------------------------------------------

def _loaded(spark, sf):
    return PP.quality_filter(_pairs(spark, sf))


@query("quality_filter")
def q_quality(spark, sf):
    """P6 loaded/skipped counts on the collected pairs, with a stricter setting (0.7, 3)."""
    return PP.quality_filter_counts(_pairs(spark, sf), min_confidence=0.7, min_models=3)


@query("to_chatml")
def q_chatml(spark, sf):
    return COL.explode_turns(PP.to_chatml(_loaded(spark, sf)), "messages")


@query("to_alpaca")
def q_alpaca(spark, sf):
    return PP.to_alpaca(_loaded(spark, sf))


@query("to_sharegpt")
def q_sharegpt(spark, sf):
    return COL.explode_turns(PP.to_sharegpt(_loaded(spark, sf)), "conversations")


@query("split_counts")
def q_split_counts(spark, sf):
    """W11 + A22: sizes of the seeded train/validation split of the loaded pairs."""
    return PP.split_counts(PP.shuffle_split(_loaded(spark, sf)))


@query("dataset_summary")
def q_dataset_summary(spark, sf):
    return PP.dataset_summary(_loaded(spark, sf))


@query("best_model_distribution")
def q_best_model_dist(spark, sf):
    return PP.best_model_distribution(_loaded(spark, sf))


# --- embedding space ------------------------------------------------------------------------------------

def _triples(spark, sf):
    return VC.triples(read_table(spark, sf, "embeddings"))


@query("cosine_similarity")
def q_cosine(spark, sf):
    return VC.per_row(_triples(spark, sf)).select("triple", "cosine")


@query("invariance_loss")
def q_inv(spark, sf):
    return VC.invariance_loss(_triples(spark, sf))


@query("variance_loss")
def q_var(spark, sf):
    return VC.variance_loss(_triples(spark, sf))


@query("covariance_loss")
def q_cov(spark, sf):
    return VC.covariance_loss(_triples(spark, sf))


def _shifted(spark, sf):
    """The triples with every value moved far from zero."""
    e = read_table(spark, sf, "embeddings")
    return VC.triples(e.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + 1e6)))


@query("covariance_loss_shifted")
def q_cov_shifted(spark, sf):
    """V4 on vectors far from zero."""
    return VC.covariance_loss(_shifted(spark, sf))


@query("variance_loss_shifted")
def q_var_shifted(spark, sf):
    """V3 on vectors far from zero."""
    return VC.variance_loss(_shifted(spark, sf))


@query("contrastive_loss")
def q_contrastive(spark, sf):
    return VC.contrastive_loss(_triples(spark, sf))


@query("collapse_report")
def q_collapse(spark, sf):
    return VC.collapse_report(_triples(spark, sf))


@query("mean_pool")
def q_mean_pool(spark, sf):
    """V7: masked mean of the vectors of each label (mask: vec_id % 5 <> 0), one row per dim."""
    e = read_table(spark, sf, "embeddings").select("label", "embedding", (F.col("vec_id") % 5 != 0).cast("int").alias("mask"))
    pooled = VC.mean_pool(e, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value"))


@query("rerank")
def q_rerank(spark, sf):
    """The target and negative of each triple reranked by cosine to the prediction."""
    tr = _triples(spark, sf)
    cands = tr.select("triple", F.posexplode(F.array("z_target", "z_negative")).alias("idx", "z"), "z_pred")
    scored = cands.select("triple", "idx", VC.cosine_similarity("z_pred", "z").alias("score"))
    return VC.rerank(scored, "triple", "idx", "score")


# --- catalog and requests ----------------------------------------------------------------------------------

# Configuration of the stand-in platform (a config file in real use): providers seen in the log,
# one disabled, roles per model id, keys for two providers.
STANDIN_CONFIG = {
    "providers": {"prov_0": {"enabled": True}, "prov_1": {"enabled": True}, "prov_2": {"enabled": False}},
    "roles": {"m0": "reasoning", "m1": "fast", "m2": "deep_reasoning", "m3": "reasoning", "m4": "fast"},
}
STANDIN_KEYS = {"prov_0": "key-0", "prov_1": "  ", "prov_2": "key-2"}
STANDIN_KEYLESS = ("prov_1",)


def _active(spark, sf):
    cat = CAT.observed_catalog(slim_log_of(spark, sf), STANDIN_CONFIG)
    return CAT.model_catalog(cat, STANDIN_KEYS, STANDIN_KEYLESS)


@query("model_catalog")
def q_model_catalog(spark, sf):
    return _active(spark, sf)


@query("filter_by_role")
def q_filter_by_role(spark, sf):
    return CAT.filter_by_role(_active(spark, sf), ["reasoning", "deep_reasoning"])


@query("platform_status")
def q_platform_status(spark, sf):
    s = CAT.platform_status(_active(spark, sf))
    return s.select(_joined(F.col("active_providers")).alias("active_providers"), "active_models", "synthesis_strategy")


@query("select_judge")
def q_select_judge(spark, sf):
    return CAT.select_judge(_active(spark, sf), "prov_2", "m2")


@query("request_defaults")
def q_request_defaults(spark, sf):
    reqs = slim_log_of(spark, sf).select("seq", "query", "strategy", F.lit(None).cast("string").alias("system_prompt"))
    return CAT.request_defaults(reqs, config_strategy=None).select("seq", "strategy", "system_prompt")


@query("validate_request")
def q_validate(spark, sf):
    """P16 on requests made from the log: strategy as logged (missing -> default), and the roles
    of the answering models' ids mapped through the config (unmapped ids give an unknown role)."""
    log = slim_log_of(spark, sf)
    roles = STANDIN_CONFIG["roles"]
    role_of = lambda x: F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in roles.items()], F.lit("unknown"))
    reqs = CAT.request_defaults(log.select(
        "seq", "strategy", F.lit(None).cast("string").alias("system_prompt"),
        F.transform("responses", lambda r: role_of(r["model_id"])).alias("roles")))
    return CAT.validate_request(reqs).select("seq", "valid", "reject_reason")


@query("fan_out")
def q_fan_out(spark, sf):
    """Every logged question with every active model of the stand-in configuration."""
    models = [{"model_id": f"m{i}", "model_name": f"model_{i}", "provider": f"prov_{i % 3}",
               "role": STANDIN_CONFIG["roles"].get(f"m{i}", R.DEFAULT_ROLE)} for i in range(6) if i % 3 != 2]
    prompts = slim_log_of(spark, sf).select("seq", "query")
    return CAT.fan_out(prompts, models).select("seq", "model_pos", "model_id", "provider", "role")


@query("catalog_lookup")
def q_catalog_lookup(spark, sf):
    log = slim_log_of(spark, sf)
    cat = CAT.observed_catalog(log, STANDIN_CONFIG)
    resp = LV.explode_responses(log, outer=False, keep=("seq",)).select("seq", "response_pos", "model_id")
    return CAT.catalog_lookup(resp, cat)


@query("request_params")
def q_request_params(spark, sf):
    log = slim_log_of(spark, sf)
    ex = LV.explode_responses(log, outer=False, keep=("seq",)).select("seq", "response_pos", "model_id")
    p = CAT.request_params("model_id", F.lit(0.7), F.lit(4096))
    return ex.select("seq", "response_pos", p.alias("p")).select("seq", "response_pos", "p.*")


@query("pseudo_quality_targets")
def q_pseudo(spark, sf):
    t = PR.triplets(slim_log_of(spark, sf))
    return t.select("seq", "triplet_no", F.posexplode(CAT.pseudo_quality_targets("good_score")).alias("dim", "target"))


@query("difficulty_steps")
def q_steps(spark, sf):
    lvl = F.array_position(F.array(*[F.lit(d) for d in R.DIFFICULTIES]), TX.estimate_difficulty("query")).cast("int") - 1
    log = slim_log_of(spark, sf)
    return log.select("seq", lvl.alias("level"), CAT.difficulty_steps(lvl).alias("steps"))


def queries() -> dict[str, Query]:
    from chorus.plans import extra  # noqa: F401  (registers the remaining queries)
    return dict(REGISTRY)
