"""Training-set preparation (P6, F21-F23, W11, A18, A19, A22) on training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import agg as AG
from chorus.functions import rules as R
from chorus.operators import selection as SEL


def quality_filter(pairs: DataFrame, min_confidence: float = R.PAIR_MIN_CONFIDENCE,
                   min_models: int = R.PAIR_MIN_RESPONSES) -> DataFrame:
    """Pairs with metadata.confidence >= min (missing 0) and num_models >= min (missing 0)."""
    return pairs.filter(_keep(min_confidence, min_models))


def _keep(min_confidence, min_models) -> Column:
    return ((F.coalesce(F.col("metadata.confidence"), F.lit(0.0)) >= min_confidence)
            & (F.coalesce(F.col("metadata.num_models"), F.lit(0)) >= min_models))


def quality_filter_counts(pairs: DataFrame, min_confidence: float = R.PAIR_MIN_CONFIDENCE,
                          min_models: int = R.PAIR_MIN_RESPONSES) -> DataFrame:
    """P6 counts: loaded and skipped."""
    keep = _keep(min_confidence, min_models)
    return pairs.agg(F.count_if(keep).alias("loaded"), F.count_if(~keep).alias("skipped"))


def to_chatml(pairs: DataFrame) -> DataFrame:
    """messages [system, user, assistant]."""
    return pairs.select("seq", F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content")),
    ).alias("messages"))


def to_alpaca(pairs: DataFrame) -> DataFrame:
    """instruction, empty input, output, system."""
    return pairs.select("seq", "instruction", F.lit("").alias("input"), "output", "system")


def to_sharegpt(pairs: DataFrame) -> DataFrame:
    """conversations [system, human, gpt] as {from, value}."""
    return pairs.select("seq", F.array(
        F.struct(F.lit("system").alias("from"), F.col("system").alias("value")),
        F.struct(F.lit("human").alias("from"), F.col("instruction").alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.col("output").alias("value")),
    ).alias("conversations"))


def split_hash(key, seed: int = R.SPLIT_SEED):
    """The place of a row in the shuffled order: MD5 of seed and key, 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffle_split(df: DataFrame, key: str = "seq", val_ratio: float = R.VAL_RATIO, seed: int = R.SPLIT_SEED,
                  bucket_bits: int = 16) -> DataFrame:
    """Seeded shuffle, then the first max(1, int(n * (1 - ratio))) rows go to ``train`` and
    the rest to ``val``. Exact sizes, disjoint, reproducible for a seed; ``key`` must be unique and not null.

    The shuffle order is ``split_hash``. The hashes are pinned in a narrow table, the last one of the training rows is
    selected there by refined histograms (``selection``), and every row is labelled by comparing its own hash with it: no
    sort, no window, no shuffle of whole rows. Python's own permutation is not reproduced; sizes and disjointness are."""
    place = split_hash(F.col(key), seed)
    hashes = SEL.pinned(df.select(place.alias("place")), "split")
    n = hashes.count()
    if not n:
        return df.withColumn("split", F.lit(None).cast("string"))
    cut = SEL.kth_digits(hashes, "place", max(1, int(n * (1.0 - val_ratio))), max(1, min(4, bucket_bits // 4)))
    return df.withColumn("split", F.when(place <= F.lit(cut), "train").otherwise("val"))


def split_counts(split_df: DataFrame) -> DataFrame:
    """Rows per split and the small-data flag (fewer than 50 training rows)."""
    g = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    train_n = F.max(F.when(F.col("split") == "train", F.col("n"))).over(Window.partitionBy())  # <= 2 rows
    return g.withColumn("small_train_set", F.coalesce(train_n, F.lit(0)) < R.SMALL_TRAIN_SET)


def dataset_summary(pairs: DataFrame) -> DataFrame:
    """Average instruction and output length (characters) and average confidence."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        (F.sum(F.length("instruction")).cast("double") / F.count(F.lit(1))).alias("avg_instruction_chars"),
        (F.sum(F.length("output")).cast("double") / F.count(F.lit(1))).alias("avg_output_chars"),
        AG.exact_avg(F.col("metadata.confidence")).alias("avg_confidence"),
    )


def best_model_distribution(pairs: DataFrame) -> DataFrame:
    """Pairs per best model and their share, most frequent first."""
    g = pairs.groupBy(F.coalesce("metadata.best_model", F.lit("unknown")).alias("best_model")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())).orderBy(
        F.col("n").desc())  # one row per model
