"""Learned scorers on Spark ML (M1-M7, V8, P9) and training-metric rollups.

Small neural heads on one machine elsewhere; here the same questions are answered by distributed models
fitted on the same tables: cross-fitted ridge regressions for the four quality scores (``operators.ridge``), multinomial
logistic regressions for difficulty and strategy, a binary one for grounding, scored by the half that did not see the row, and a
Bradley-Terry model for rewards (``operators.reward``).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import rules as R
from chorus.operators import catalog as CAT
from chorus.operators import ridge as RG
from chorus.operators import scoring as SC
from chorus.operators import selection as SEL
from chorus.operators import vectors as VC

DIMS = [n for n, _ in R.SCORE_WEIGHTS]
HASH_FEATURES = 1 << 12


def _tokens(df: DataFrame, col: str, out: str) -> DataFrame:
    return RegexTokenizer(inputCol=col, outputCol=out, pattern="\\W+", toLowercase=True).transform(df)


def _tf(df: DataFrame, col: str, out: str) -> DataFrame:
    tok = _tokens(df, col, out + "_tok")
    return HashingTF(inputCol=out + "_tok", outputCol=out, numFeatures=HASH_FEATURES).transform(tok).drop(out + "_tok")


def quality_regressor(labeled: DataFrame, features: str = "embedding", target: str = "quality_target", key: str = "vec_id") -> DataFrame:
    """M1: one ridge regression for the four quality dimensions on embedding features (``ridge``); targets are the
    pseudo-quality vector (F20). Every row is scored by the folds that did not see it, clipped to [0, 1] as ``pred_<dim>``; the
    unclipped score and the constant of the same fit are ``raw_<dim>`` and ``raw_<dim>_mean``."""
    fold = RG.fold_of(F.col(key))
    coefficients = RG.cross_fit(labeled, features, quality_targets(target), fold)
    scored = RG.predicted(labeled, features, coefficients, fold, [f"raw_{n}" for n in DIMS])
    return scored.select("*", *[_clip(f"raw_{n}").alias(f"pred_{n}") for n in DIMS])


def quality_targets(target: str = "quality_target") -> list:
    return [CAT.pseudo_quality_targets(F.col(target))[i] for i in range(len(DIMS))]


def quality_report(labeled: DataFrame) -> DataFrame:
    """Held-out error of M1 per dimension beside that of a constant."""
    scored = quality_regressor(labeled)
    return RG.held_out(scored, {f"raw_{n}": t for n, t in zip(DIMS, quality_targets(), strict=True)}).withColumn("target", F.substring("target", 5, 100))


def _clip(c: str):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))


def embedding_features(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", (F.col("vec_id") / 3).cast("long").alias("triple"), "label", "embedding", (F.col("label") / F.lit(9.0)).alias("quality_target"))


def difficulty_classifier(questions: DataFrame, query_col: str = "query") -> DataFrame:
    """M2: multinomial logistic regression from hashed query words to the F2 difficulty."""
    from chorus.functions import text as TX
    d = _tf(questions, query_col, "features").withColumn(
        "label", (F.array_position(F.array(*[F.lit(x) for x in R.DIFFICULTIES]), TX.estimate_difficulty(query_col)) - 1).cast("double"))
    model = LogisticRegression(family="multinomial", maxIter=50, regParam=0.01).fit(d)
    p = model.transform(d)
    return p.select("*", F.get(F.array(*[F.lit(x) for x in R.DIFFICULTIES]), F.col("prediction").cast("int")).alias("predicted_difficulty"))


def strategy_classifier(questions: DataFrame, best_by_type: DataFrame, query_col: str = "query") -> DataFrame:
    """M3: multinomial logistic regression from hashed query words to the best strategy of the
    question's type (W6); classes in the planner's strategy order."""
    from chorus.functions import text as TX
    q = questions.withColumn("question_type", TX.classify_question(query_col)).join(
        F.broadcast(best_by_type.select("question_type", "strategy")), "question_type", "left")  # <= 10 rows
    order = F.array(*[F.lit(s) for s in R.PLAN_STRATEGY_ORDER])
    d = _tf(q, query_col, "features").withColumn(
        "label", (F.array_position(order, F.coalesce("strategy", F.lit(R.DEFAULT_STRATEGY))) - 1).cast("double"))
    model = LogisticRegression(family="multinomial", maxIter=50, regParam=0.01).fit(d)
    p = model.transform(d)
    return p.select("*", F.get(order, F.col("prediction").cast("int")).alias("predicted_strategy"))


def fit_grounding(triples: DataFrame):
    """M4: binary logistic regression on concat(question, answer) embeddings: the target answer
    is grounded (1), the negative is not (0)."""
    pos = triples.select(F.concat("z_pred", "z_target").alias("z"), F.lit(1.0).alias("label"))
    neg = triples.select(F.concat("z_pred", "z_negative").alias("z"), F.lit(0.0).alias("label"))
    d = pos.unionByName(neg).withColumn("features", array_to_vector("z"))
    return LogisticRegression(maxIter=50, regParam=0.01).fit(d)


def apply_grounding(model, df: DataFrame, question: str, answer: str) -> DataFrame:
    """P9 with M4: hallucination probability = 1 - p(grounded); grounded when below 0.3."""
    x = df.withColumn("features", array_to_vector(F.concat(question, answer)))
    p = model.transform(x).withColumn("hallucination_probability", F.lit(1.0) - vector_to_array("probability")[1])
    return p.withColumn("is_grounded", F.col("hallucination_probability") < R.GROUNDED_BELOW).drop(
        "features", "rawPrediction", "probability", "prediction")


HALVES = 2


def _by_other_half(triples: DataFrame, rows: DataFrame, answer: str) -> DataFrame:
    """``rows`` of triples scored by a grounding model that was fitted on the triples of the other half."""
    half = RG.fold_of(F.col("triple"), HALVES)
    out = None
    for k in range(HALVES):
        other = triples.where(half != k)
        if other.isEmpty():
            continue
        scored = apply_grounding(fit_grounding(other), rows.where(half == k), "z_pred", answer)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = rows.limit(0).withColumn("hallucination_probability", F.lit(0.0)).withColumn("is_grounded", F.lit(False))
    return out


def grounding_classifier(triples: DataFrame) -> DataFrame:
    """M4 + P9 on the (question, target) and (question, negative) pairs of each triple; the triples of each half are scored by
    the model of the other half, so no pair is scored by a model that saw it."""
    pos = triples.select("triple", "z_pred", F.col("z_target").alias("z_answer"), F.lit(1.0).alias("label"))
    neg = triples.select("triple", "z_pred", F.col("z_negative").alias("z_answer"), F.lit(0.0).alias("label"))
    return _by_other_half(triples, pos.unionByName(neg), "z_answer")


def grounding_report(triples: DataFrame) -> DataFrame:
    """Held-out accuracy of M4 at probability 0.5 beside the share of the larger class."""
    right = (F.col("hallucination_probability") < 0.5) == (F.col("label") == 1.0)
    share = F.avg("label")
    return grounding_classifier(triples).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))


def embedding_evaluate(embeddings: DataFrame) -> DataFrame:
    """V8: overall score (A1 weights over the predicted quality of the answer embedding), the
    grounded flag (M4, P9) and the reasoning similarity (V1) of each (question, answer) triple. All models are cross-fitted by
    triple: none has seen a vector of the triple that it scores."""
    labeled = embedding_features(embeddings)
    fold = RG.fold_of(F.col("triple"))
    coefficients = RG.cross_fit(labeled, "embedding", quality_targets(), fold)
    tri = VC.triples(embeddings)
    x = RG.predicted(tri, "z_target", coefficients, fold, [f"raw_{n}" for n in DIMS])
    x = x.select(*tri.columns, *[_clip(f"raw_{n}").alias(f"pred_{n}") for n in DIMS])
    x = _by_other_half(tri, x, "z_target")
    overall = SC.weighted_total(*[F.col(f"pred_{n}") for n in DIMS])
    return x.select("triple", overall.alias("overall_score"), *[f"pred_{n}" for n in DIMS], "hallucination_probability",
                    "is_grounded", VC.cosine_similarity("z_pred", "z_target").alias("reasoning_similarity"))


def best_of_n_by_reward(scored: DataFrame, group: str = "seq", idx: str = "response_pos") -> DataFrame:
    """M6: the answer with the highest reward per question (first by position on ties)."""
    w = Window.partitionBy(group).orderBy(F.col("reward").desc(), F.col(idx))
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rejection_filter(scored: DataFrame, quantile: float = 0.5) -> DataFrame:
    """M7: answers whose reward is at least the quantile: the ceil(quantile * n)-th smallest reward, selected exactly.

    ``scored`` is pinned, so that rewards are computed once; keep only the columns that are needed. A null or NaN reward is
    never kept and does not count."""
    held = SEL.pinned(scored, "rewards").where(F.col("reward").isNotNull() & ~F.isnan("reward"))
    n = held.count()
    if not n:
        return held
    return held.where(F.col("reward") >= F.lit(SEL.kth_double(held, "reward", max(1, math.ceil(quantile * n)))))


# --- training metrics (A20, A21) ---------------------------------------------------------------

def batch_losses(triples: DataFrame, epochs: int = 3, batches: int = 8) -> DataFrame:
    """Per (epoch, batch) losses of mini-batches of triples: invariance (mean squared
    difference), contrastive (margin loss) and their weighted total. Batch = (7 triple + 3
    epoch) mod batches."""
    ep = triples.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    ep = ep.withColumn("batch", ((F.col("triple") * 7 + F.col("epoch") * 3) % batches).cast("int"))
    sq = VC._dsum(F.zip_with("z_pred", "z_target", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    r = ep.select("epoch", "batch", sq.alias("sq"), F.size("z_pred").alias("d"),
                  F.greatest(F.lit(0.0), VC.pairwise_distance("z_pred", "z_target") - VC.pairwise_distance("z_pred", "z_negative")
                             + F.lit(R.CONTRASTIVE_MARGIN)).alias("m"))
    from chorus.functions.agg import DEC_SQ
    g = r.groupBy("epoch", "batch").agg(
        (F.sum(F.col("sq").cast(DEC_SQ)).cast("double") / F.sum("d")).alias("invariance"),
        (F.sum(F.col("m").cast(DEC_SQ)).cast("double") / F.count(F.lit(1))).alias("contrastive"))
    w = dict(R.LOSS_WEIGHTS)
    return g.withColumn("total", F.col("invariance") * w["invariance"] + F.col("contrastive") * w["contrastive"])


def epoch_means(losses: DataFrame) -> DataFrame:
    """Mean of each loss over the batches of an epoch (no batches: no row)."""
    from chorus.functions.agg import DEC_SQ
    mean = lambda c: F.sum(F.col(c).cast(DEC_SQ)).cast("double") / F.count(c)
    return losses.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_batches"),
                                       *[mean(c).alias(c) for c in ("invariance", "contrastive", "total")])


def best_epoch(means: DataFrame) -> DataFrame:
    """The epoch with the lowest total loss, the first one on ties."""
    b = means.agg(F.min(F.struct("total", "epoch")).alias("b"))
    return b.select(F.col("b.epoch").alias("best_epoch"), F.col("b.total").alias("best_loss"))
