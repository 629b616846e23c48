"""Collection of training pairs and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import agg as AG
from chorus.functions import defaults as D
from chorus.functions import rules as R
from chorus.functions import text as TX
from chorus.operators.logview import n_responses, response_fields
from chorus.operators.scoring import best_response


def pair_eligible(min_confidence: float = R.PAIR_MIN_CONFIDENCE, min_responses: int = R.PAIR_MIN_RESPONSES,
                  min_chars: int = R.PAIR_MIN_ANSWER_CHARS):
    """P4 as a column: confidence >= 0.6, at least 2 answers (errored ones count), stripped final
    answer of at least 50 characters."""
    answer = F.coalesce(F.col("final_answer"), F.lit(""))
    return (
        (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
        & (F.coalesce(n_responses(), F.lit(0)) >= min_responses)
        & (answer != "")
        & (F.length(TX.py_strip(answer)) >= min_chars)
    )


def training_pair_filter(log: DataFrame, **kw) -> DataFrame:
    """Entries that yield a training pair."""
    return log.filter(pair_eligible(**kw))


def training_pairs(log: DataFrame, system: str = D.SYSTEM_TEXT, **kw) -> DataFrame:
    """P5: instruction/output pairs with metadata; the best answer is the argmax of total_score,
    the first on ties. Shape: id, timestamp, system, instruction, output, metadata{...}."""
    best = best_response(response_fields("model_name", "total_score"))
    return training_pair_filter(log, **kw).select(
        "seq", "id", "timestamp",
        F.lit(system).alias("system"),
        F.col("query").alias("instruction"),
        F.col("final_answer").alias("output"),
        F.struct(
            F.col("confidence").alias("confidence"),
            F.col("strategy").alias("strategy"),
            n_responses().alias("num_models"),
            best["model_name"].alias("best_model"),
            best["total_score"].alias("best_model_score"),
            F.coalesce(F.size("consensus_points"), F.lit(0)).alias("consensus_count"),
            F.coalesce(F.size("disagreement_points"), F.lit(0)).alias("disagreement_count"),
        ).alias("metadata"),
    )


def training_stats(log: DataFrame) -> DataFrame:
    """One row of totals: queries, answers, training pairs, average confidence."""
    return log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.coalesce(F.sum(n_responses()), F.lit(0)).cast("long").alias("total_responses"),
        F.count_if(pair_eligible()).alias("training_pairs"),
        AG.exact_avg(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("avg_confidence"),
    )


def strategy_counts(log: DataFrame) -> DataFrame:
    """Entries per strategy (the map of the stats file, as rows)."""
    return log.groupBy(F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY)).alias("strategy")).agg(
        F.count(F.lit(1)).alias("n"))


def model_counts(log: DataFrame) -> DataFrame:
    """Answers per model."""
    ex = log.select(F.explode(F.col("responses.model_name")).alias("model_name"))
    return ex.groupBy(F.coalesce("model_name", F.lit("unknown")).alias("model_name")).agg(F.count(F.lit(1)).alias("n"))


def model_wins(log: DataFrame) -> DataFrame:
    """Rank-1 answers per model."""
    ex = log.select(F.explode(response_fields("model_name", "rank")).alias("r")).filter(F.col("r.rank") == 1)
    return ex.groupBy(F.coalesce("r.model_name", F.lit("unknown")).alias("model_name")).agg(F.count(F.lit(1)).alias("wins"))


def readiness(pairs_col) -> tuple:
    """A10 columns from a training-pair count: tier and capped percentage (one decimal)."""
    tp = F.coalesce(pairs_col, F.lit(0))
    tier = None
    for limit, name in R.READINESS_TIERS:
        tier = F.when(tp >= limit, name) if tier is None else tier.when(tp >= limit, name)
    tier = tier.otherwise(R.READINESS_DEFAULT)
    pct = F.least(F.lit(100.0), TX.py_round(tp.cast("double") / F.lit(float(R.READINESS_FULL_AT)) * F.lit(100.0), 1))
    return tier, pct


def training_readiness(log: DataFrame) -> DataFrame:
    """A10: tier at 100 / 500 / 1000 pairs and the capped percentage."""
    counted = log.agg(F.count_if(pair_eligible()).alias("training_pairs"))
    tier, pct = readiness(F.col("training_pairs"))
    return counted.select("training_pairs", tier.alias("training_readiness"), pct.alias("training_readiness_pct"))


def stats_snapshot(log: DataFrame) -> DataFrame:
    """A6-A10 in one row, maps included (the stats file's shape, without internal totals).

    One scan: answers are counted by (strategy, model), a question counting on its first answer's row
    only; the totals and the three maps are grouping sets of that small table."""
    slim = log.select(F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY)).alias("strategy"), pair_eligible().alias("pair"),
                      F.coalesce("confidence", F.lit(0.0)).cast(AG.DEC).alias("conf"),
                      F.posexplode_outer(response_fields("model_name", "rank")).alias("pos", "r"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    model = F.when(F.col("pos").isNotNull(), F.coalesce(F.col("r.model_name"), F.lit("unknown")))
    t = slim.groupBy("strategy", model.alias("model_name")).agg(
        F.count_if(first).alias("q"), F.count_if(first & F.col("pair")).alias("pairs"),
        F.sum(F.when(first, F.col("conf"))).alias("conf"), F.count("pos").alias("n"), F.count_if(F.col("r.rank") == 1).alias("wins"))
    g = t.groupingSets([["strategy"], ["model_name"], []], "strategy", "model_name").agg(
        F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ("q", "pairs", "conf", "n", "wins")])
    of = lambda c: F.max(F.when(F.col("gid") == 3, F.col(c)))
    entries = lambda when, key, n: F.map_from_entries(F.collect_list(F.when(when, F.struct(F.col(key).alias("key"), F.col(n).alias("n")))))
    by_model = (F.col("gid") == 2) & F.col("model_name").isNotNull()
    one = g.agg(
        F.coalesce(of("q"), F.lit(0)).alias("total_queries"), F.coalesce(of("n"), F.lit(0)).alias("total_responses"),
        F.coalesce(of("pairs"), F.lit(0)).alias("training_pairs"), (of("conf").cast("double") / of("q")).alias("avg_confidence"),
        entries(F.col("gid") == 1, "strategy", "q").alias("strategy_counts"), entries(by_model, "model_name", "n").alias("model_counts"),
        entries(by_model & (F.col("wins") > 0), "model_name", "wins").alias("model_wins"))
    tier, pct = readiness(F.col("training_pairs"))
    return one.select("*", tier.alias("training_readiness"), pct.alias("training_readiness_pct"))


def export_chat_log(pairs: DataFrame) -> DataFrame:
    """K5: pairs -> ``conversations`` [{role, content}] (system, user, assistant) + metadata."""
    return pairs.select(
        "seq",
        F.array(
            F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content")),
        ).alias("conversations"),
        "metadata",
    )


def explode_turns(df: DataFrame, col: str, key: str = "seq") -> DataFrame:
    """One row per turn of a chat array (for flat output and checks)."""
    return df.select(key, F.posexplode(col).alias("turn", "t")).select(key, "turn", "t.*")


# The service's zero default when no stats exist yet (schema, row).
READINESS_DEFAULT_ROW = (
    "total_queries long, total_responses long, training_pairs long, avg_confidence double, "
    "training_readiness string, training_readiness_pct double, model_counts map<string,long>, "
    "model_wins map<string,long>, strategy_counts map<string,long>, raw_file_mb double, training_file_mb double",
    (0, 0, 0, 0.0, R.READINESS_DEFAULT, 0.0, {}, {}, {}, 0.0, 0.0),
)
