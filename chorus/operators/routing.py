"""Routing from past performance.

The performance tables are aggregates keyed by question type, and question types come from a
fixed list of ten, so every per-type table has at most ten rows: broadcasting it to the
questions being routed is bounded by the rule table, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import agg as AG
from chorus.functions import rules as R
from chorus.functions import text as TX

QTYPE = "question_type"


def with_question_type(log: DataFrame) -> DataFrame:
    """F1 at entry grain (computed once per question, before any explode); the text is
    lowercased once in its own projection."""
    return log.withColumn("_lq", F.lower("query")).withColumn(QTYPE, TX.classify_lowered(F.col("_lq"))).drop("_lq")


def model_perf(log: DataFrame) -> DataFrame:
    """A3: by (question type, model): average score, count, sample std (0 when n < 2), and the
    first position the pair was seen at (tie-breaker, T1). Errored answers count; questions
    without answers do not (T13)."""
    from chorus.operators.logview import response_fields
    slim = log.select("seq", "query", response_fields("model_name", "total_score").alias("answers"))
    ex = with_question_type(slim).select("seq", QTYPE, F.posexplode("answers").alias("pos", "r"))
    score = F.coalesce(F.col("r.total_score"), F.lit(0.0))
    return ex.groupBy(QTYPE, F.coalesce("r.model_name", F.lit("unknown")).alias("model_name")).agg(
        AG.exact_avg(score).alias("avg_score"),
        F.count(F.lit(1)).alias("n"),
        AG.exact_std(score).alias("std_score"),
        F.min(AG.first_seen_key("seq", "pos")).alias("first_seen"),
    )


def strategy_perf(log: DataFrame) -> DataFrame:
    """A4: by (question type, strategy): average confidence and count. Missing strategy is
    weighted_merge and missing confidence 0 (T3)."""
    q = with_question_type(log.select("seq", "query", "strategy", "confidence"))
    return q.groupBy(QTYPE, F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY)).alias("strategy")).agg(
        AG.exact_avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"),
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("first_seen"),
    )


def type_counts(log: DataFrame, strat: DataFrame | None = None) -> DataFrame:
    """A5: entries per question type, with the total over all types. Derived from the
    (type, strategy) table when given (every entry has exactly one strategy)."""
    if strat is None:
        counts = with_question_type(log.select("query")).groupBy(QTYPE).agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = strat.groupBy(QTYPE).agg(F.sum("n").alias("n"))
    # at most ten rows here, so the global window is over ten rows
    return counts.withColumn("total_queries", F.sum("n").over(Window.partitionBy()))


def top_models_by_type(perf: DataFrame) -> DataFrame:
    """W5 ranking: models of a type by average score desc, first seen first on ties."""
    w = Window.partitionBy(QTYPE).orderBy(F.col("avg_score").desc(), F.col("first_seen"))
    return perf.withColumn("model_rank", F.row_number().over(w))


def best_strategy(strat: DataFrame) -> DataFrame:
    """The strategy with the highest average confidence per type, first seen on ties."""
    w = Window.partitionBy(QTYPE).orderBy(F.col("avg_confidence").desc(), F.col("first_seen"))
    return strat.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def performance_table(log: DataFrame) -> DataFrame:
    """A3 + A4 + A5 in one pass and one shuffle, keyed by (type, strategy, model): answers are
    exploded with ``posexplode_outer`` (a question without answers keeps one NULL-model row);
    question-level sums are taken on each question's first row only. Folding over models gives
    the strategy table, folding over strategies the model table."""
    slim = log.select("seq", "query", "strategy", "confidence", _fields("model_name", "total_score").alias("answers"))
    q = with_question_type(slim).select(
        "seq", QTYPE, F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY)).alias("strategy"),
        F.coalesce("confidence", F.lit(0.0)).alias("conf"), F.posexplode_outer("answers").alias("pos", "r"))
    first_row = F.col("pos").isNull() | (F.col("pos") == 0)
    answered = F.col("pos").isNotNull()
    score = F.coalesce(F.col("r.total_score"), F.lit(0.0)).cast(AG.DEC)
    return q.groupBy(QTYPE, "strategy", F.when(answered, F.coalesce(F.col("r.model_name"), F.lit("unknown"))).alias("model_name")).agg(
        F.count_if(first_row).alias("questions"),
        F.sum(F.when(first_row, F.col("conf").cast(AG.DEC))).alias("conf_sum"),
        F.min(F.when(first_row, F.col("seq"))).alias("strategy_first_seen"),
        F.count("pos").alias("n"),
        F.sum(F.when(answered, score)).alias("s"),
        F.sum(F.when(answered, score * score)).alias("ss"),
        F.min(F.when(answered, AG.first_seen_key("seq", "pos"))).alias("first_seen"),
    )


def _fields(*names):
    from chorus.operators.logview import response_fields
    return response_fields(*names)


def performance_by_type(log: DataFrame) -> DataFrame:
    """The router's performance table, one row per question type (at most ten rows): models in
    rank order with their averages, best strategy, and number of questions (D10). One scan of
    the log; everything after the first aggregate works on at most types x strategies x models
    rows."""
    return folded(performance_table(log))


def folded(table: DataFrame) -> DataFrame:
    """The rows of ``performance_table`` as one row per question type."""
    return table.groupBy(QTYPE).agg(
        F.sum("questions").alias("type_count"),
        F.collect_list(F.when(F.col("n") > 0, F.struct("model_name", "n", "s", "first_seen"))).alias("_m"),
        F.collect_list(F.when(F.col("questions") > 0, F.struct("strategy", "questions", "conf_sum", "strategy_first_seen"))).alias("_st"),
    ).select(QTYPE, "type_count", _rank_models(F.col("_m")).alias("ranked_models"), _best_strategy(F.col("_st")).alias("best_strategy"))


def _rank_models(rows):
    """Fold the (strategy, model) rows of one type into models ranked by average desc, first
    seen first on ties."""
    names = F.array_distinct(F.transform(rows, lambda r: r["model_name"]))
    per_model = F.transform(names, lambda m: F.struct(
        F.aggregate(F.filter(rows, lambda r: r["model_name"] == m), F.struct(F.lit(0).cast("decimal(38,9)").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("f")),
                    lambda acc, r: F.struct((acc["s"] + r["s"]).cast("decimal(38,9)").alias("s"), (acc["n"] + r["n"]).alias("n"),
                                            F.least(acc["f"], r["first_seen"]).alias("f"))).alias("a"), m.alias("m")))
    keyed = F.transform(per_model, lambda x: F.struct((-(x["a"]["s"].cast("double") / x["a"]["n"])).alias("k"), x["a"]["f"].alias("f"),
                                                      x["m"].alias("model_name"), (x["a"]["s"].cast("double") / x["a"]["n"]).alias("avg_score")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["model_name"].alias("model_name"), x["avg_score"].alias("avg_score")))


def _best_strategy(rows):
    names = F.array_distinct(F.transform(rows, lambda r: r["strategy"]))
    per = F.transform(names, lambda st: F.aggregate(
        F.filter(rows, lambda r: r["strategy"] == st),
        F.struct(F.lit(0).cast("decimal(38,9)").alias("c"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("f")),
        lambda acc, r: F.struct((acc["c"] + r["conf_sum"]).cast("decimal(38,9)").alias("c"), (acc["q"] + r["questions"]).alias("q"),
                                F.least(acc["f"], r["strategy_first_seen"]).alias("f")),
        lambda acc: F.struct((-(acc["c"].cast("double") / acc["q"])).alias("k"), acc["f"].alias("f"), st.alias("strategy"))))
    return F.get(F.sort_array(per), 0)["strategy"]


def save_performance(perf_by_type: DataFrame, path: str) -> None:
    """K4: persist the performance table (overwrite). Refresh = recompute and save again."""
    perf_by_type.write.mode("overwrite").parquet(path)


def load_or_build_performance(spark, log: DataFrame, path: str | None, refresh: bool = False) -> DataFrame:
    """The saved table when it exists (checked through the cluster's file system), else built
    from the log and saved. ``refresh=True`` rebuilds and overwrites it (K4's invalidation)."""
    from chorus.sources.io import _exists
    if path and not refresh and _exists(spark, path):
        return spark.read.parquet(path)
    perf = performance_by_type(log)
    if path:
        save_performance(perf, path)
        return spark.read.parquet(path)
    return perf


def _top_k(difficulty):
    k = None
    for d, n in R.TOP_MODELS_BY_DIFFICULTY:
        k = F.when(difficulty == d, F.lit(n)) if k is None else k.when(difficulty == d, F.lit(n))
    return k  # NULL = all models


def route(questions: DataFrame, perf_by_type: DataFrame, query_col: str = "query") -> DataFrame:
    """one routing decision (D11) per question: type, difficulty, recommended models,
    strategy, temperature, meta-reasoning flag, depth, router confidence and explanation."""
    q = questions.withColumn(QTYPE, TX.classify_question(query_col)).withColumn(
        "difficulty", TX.estimate_difficulty(query_col))
    j = q.join(F.broadcast(perf_by_type), QTYPE, "left")  # <= 10 rows, one per question type
    models = F.coalesce(F.col("ranked_models"), F.array())
    n_models = F.size(models)
    k = _top_k(F.col("difficulty"))
    chosen = F.when(k.isNull(), models).otherwise(F.slice(models, 1, F.coalesce(k, F.lit(1))))
    default_strategy = TX.lookup("difficulty", R.STRATEGY_BY_DIFFICULTY, R.DEFAULT_STRATEGY)
    count = F.coalesce(F.col("type_count"), F.lit(0))
    top = F.get(models, 0)
    explanation = F.concat_ws(
        ". ",
        F.concat(F.lit("Question type: "), F.col(QTYPE)),
        F.concat(F.lit("Difficulty: "), F.col("difficulty")),
        F.when(n_models > 0, F.concat(F.lit("Best model for "), F.col(QTYPE), F.lit(": "), top["model_name"],
                                      F.lit(" ("), TX.percent0(top["avg_score"]), F.lit(")"))),
        F.when(count > 0, F.format_string("Based on %d previous %s queries", count, F.col(QTYPE)))
        .otherwise(F.lit("No historical data — using defaults")),
    )
    return j.select(
        *[c for c in questions.columns],
        QTYPE, "difficulty",
        F.transform(chosen, lambda m: m["model_name"]).alias("recommended_models"),
        F.coalesce(F.col("best_strategy"), default_strategy).alias("recommended_strategy"),
        TX.route_temperature(F.col(QTYPE)).alias("temperature"),
        TX.use_meta_reasoning(F.col(QTYPE), F.col("difficulty")).alias("use_meta_reasoning"),
        TX.route_depth(F.col("difficulty")).alias("reasoning_depth"),
        TX.route_confidence(count).alias("confidence"),
        explanation.alias("explanation"),
    )


def perf_lookup(questions: DataFrame, perf_by_type: DataFrame, query_col: str = "query") -> DataFrame:
    """Left lookup of the performance table by the question's type."""
    q = questions.withColumn(QTYPE, TX.classify_question(query_col))
    return q.join(F.broadcast(perf_by_type), QTYPE, "left")
