"""Operator 4, sharding: a uniform shuffle into shards of exact sizes.

Rows are dealt into partitions by a hash of the row and of its number among identical rows. For the counts of rows in each partition, the
communication matrix (how many rows of partition p go to shard s) is drawn from the multivariate
hypergeometric law that a uniformly random shuffle has. Each partition orders its rows by a seeded
hash (the local permutation) and cuts them by its row of the matrix; the pieces are exchanged; every
shard orders what it got by a second seeded hash, which fixes the slots. All this is done with a row's number and two hashes of it;
whole rows are stored once and move once. Shard sizes are exact: counts
differ by at most one.

The law is ``rows``: sizes in rows at most one apart. Equal texts are separate rows and are spread
like any others, so a large group of copies cannot fill a shard. Identical rows are numbered in runs of at most
2^``RUN_BITS`` rows, whose sizes are summed up, so no task holds all copies of a row; the numbers enter every hash.

Defined results: an empty table gives no rows; fewer rows than shards leave the last shards empty;
nulls in any column are ordinary values; identical rows are interchangeable, each gets its own
slot; very long texts are measured whole; extra columns travel along and names that clash with the
new ones get a trailing underscore on the new column.

Scale: partitions and the sub-ranges in which slots are counted grow in number with the rows
(``per_partition``), so no task holds a shard. The matrix is drawn in two levels: the driver holds ``FAN`` rows
of it whatever the size of the data, a task per group of partitions draws the rest. The cut positions are broadcast
only below 2^20 numbers, else joined by a shuffle. All draws come from ``seed`` and the row counts, and rows are
placed by their hashes, so a lost executor's tasks give the same rows again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.shared import folder, stored
from chorus.llm.textarrays import fresh, quoted

SHARDS = 24
PER_PARTITION = 20_000
FAN = 256                           # groups of partitions; the driver draws one row of the matrix for each
SEED = 20_260
RUN_BITS = 12                       # identical rows are numbered in runs of at most 2^12 rows


def communication_matrix(counts: list[int], room: list[int], seed: int | list[int]) -> np.ndarray:
    """Rows from each source to each target, as a uniform shuffle would send them: ``counts`` rows come
    from the sources, ``room`` rows fit into the targets, both with the same sum."""
    room = np.array(room, np.int64)
    draw = np.random.default_rng(seed)
    out = np.zeros((len(counts), len(room)), np.int64)
    for p, n in enumerate(counts):
        left = n
        for s in range(len(room)):       # one hypergeometric draw per cell, by conditioning
            rest = int(room[s + 1 :].sum())
            out[p, s] = _hypergeometric(draw, int(room[s]), rest, left) if left else 0
            left -= int(out[p, s])
        room -= out[p]
    return out


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw; beyond the generator's range by rejection, with the same law."""
    return int(draw.hypergeometric(good, bad, n)) if good + bad < 10**9 else _by_rejection(draw, good, bad, n)


def _by_rejection(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw by the ratio of uniforms (Stadlober's HRUA), for populations of any size."""
    total, few, m = good + bad, min(good, bad), min(n, good + bad - n)
    low, high = max(0, m - max(good, bad)), min(m, few)
    if low == high:
        k = low
    else:
        mean = m * (few / total) + 0.5
        spread = ((total - m) / (total - 1) * m * (few / total) * (1 - few / total) + 0.5) ** 0.5
        wide = 1.7155277699214135 * spread + 0.8989161620588988
        mode = (m + 1) * (few + 1) // (total + 2)
        while True:
            x, y = 1 - draw.random(), draw.random()
            k = math.floor(mean + wide * (y - 0.5) / x)
            if not low <= k <= high:
                continue
            d = k - mode
            # log of P(k) / P(mode)
            ratio = -(_growth(mode, d) + _growth(few - mode, -d) + _growth(m - mode, -d) + _growth(total - few - m + mode, d))
            if 2 * math.log(x) <= ratio:
                break
    if good > bad:
        k = m - k
    return k if m == n else good - k


def _growth(a: int, d: int) -> float:
    """log((a + d)! / a!), by differences where the factorials are too large for their own logarithms."""
    if min(a, a + d) < 1000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    rest = lambda z: 1 / (12 * z) - 1 / (360 * z**3)
    return (a + d + 0.5) * math.log1p(d / a) + d * math.log(a) - d + rest(a + d) - rest(a)


def cut_positions(counts: DataFrame, shards: int, seed: int, fan: int = FAN) -> DataFrame:
    """(part, ends): the last local position of each shard's piece in every partition.

    ``counts`` has (part, n). The matrix is drawn in two levels: the driver draws how many rows of each
    group of partitions go to each shard, a task per group then splits its rows among its partitions.
    Drawing a group first and its members given the group is the same law as drawing all at once."""
    grouped = counts.withColumn("team", F.pmod(F.xxhash64("part", F.lit(seed)), F.lit(fan)).cast("int"))
    teams = sorted((r.team, r.n) for r in grouped.groupBy("team").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in teams)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in teams], room, seed)
    given = {team: row for (team, _), row in zip(teams, matrix.tolist(), strict=True)}

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        team = int(pdf["team"].iloc[0])
        cells = communication_matrix(pdf["n"].tolist(), given[team], [seed, team + 1])
        return pd.DataFrame({"part": pdf["part"], "ends": np.cumsum(cells, axis=1).tolist()})

    return grouped.groupBy("team").applyInPandas(split, "part int, ends array<bigint>")


def copy_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` (spot, a, b) with ``copy``: the number of each row among those of equal (a, b), from 0.

    Rows that occur more than once are stored in the order of their hashes within their partitions, so that copies there are
    neighbours; they are cut into runs, and a run starts at the number of copies in the runs before it."""
    often = stored(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), "often")
    if often.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    again = rows.join(often, ["a", "b"], "left_semi").sortWithinPartitions("a", "b").withColumn("at", F.monotonically_increasing_id())
    held = stored(again.withColumn("run", F.shiftright("at", RUN_BITS)), "copies")
    earlier = Window.partitionBy("a", "b").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("a", "b", "run").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    moved = stored(runs.select("a", "b", "run", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("moved")), "runs")
    copies = held.join(moved, ["a", "b", "run"]).select("spot", (F.col("at") + F.col("moved")).alias("copy"))
    return rows.join(copies, "spot", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("long")))


def hashed(df: DataFrame, plain: list[Column], seed: int, names: tuple[str, str, str]) -> DataFrame:
    """``df``, stored, with a number for each row and two hashes of ``plain``, under ``names``."""
    spot, a, b = names
    return stored(df.withColumns({a: F.xxhash64(*plain, F.lit(seed)), b: F.xxhash64(*plain, F.lit(seed + 4))}).withColumn(spot, F.monotonically_increasing_id()), "rows")


def numbered(df: DataFrame, plain: list[Column], copy: str, seed: int) -> DataFrame:
    """``df`` with ``copy``: the number of each row among those equal in ``plain``, from 0. Rows that occur once have 0."""
    spot, a, b = names = tuple(fresh(df, n) for n in ("row_spot", "row_a", "row_b"))
    held = hashed(df, plain, seed, names)
    numbers = copy_numbers(held.select(F.col(spot).alias("spot"), F.col(a).alias("a"), F.col(b).alias("b"))).select(F.col("spot").alias(spot), F.col("copy").alias(copy))
    return held.join(numbers, spot).select(*[quoted(c) for c in df.columns], copy)


def placed(rows: DataFrame, shards: int, seed: int, per_partition: int, fan: int) -> DataFrame:
    """(spot, shard, slot) of narrow rows (spot, a, b, copy): the two permutations and the exchange between them."""
    key = [F.col(c) for c in ("a", "b", "copy")]
    total = rows.count()
    parts = max(1, -(-total // per_partition))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(parts)).cast("int"))
    counts = stored(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "counts")
    table = stored(cut_positions(counts, shards, seed, fan), "cuts")

    # the cut positions of each partition join its rows; small by measured size, they are broadcast
    local = Window.partitionBy("part").orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key)
    sent = dealt.withColumn("first", F.row_number().over(local)).join(F.broadcast(table) if parts * shards < 1 << 20 else table, "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("first"))))

    # slots: order within a shard by ranges of the second hash
    ranges = max(1, -(-(total // shards) // per_partition))
    sent = sent.withColumn("second", F.xxhash64(*key, F.lit(seed + 3)))
    sent = sent.withColumn("range", F.shiftright(F.shiftrightunsigned(F.col("second"), 32) * ranges, 32).cast("int")).select("spot", *key, "shard", "second", "range")
    if ranges > 1:
        sent = stored(sent, "sent")
    ranked = sent.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "range").orderBy("second", *key)).cast("long") - 1)
    if ranges > 1:
        tally = sent.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        tally = tally.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(tally, ["shard", "range"]).withColumn("slot", F.col("slot") + F.col("before"))
    return ranked.select("spot", "shard", "slot")


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED, per_partition: int = PER_PARTITION, fan: int = FAN) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within a shard).

    The rows are stored once under a number; numbering copies, dealing, cutting and ordering all work on that number and two hashes
    of the row, and whole rows move once, when they meet their shard and slot."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    shard, slot = fresh(df, "shard"), fresh(df, "slot")
    spot, a, b = names = tuple(fresh(df, n) for n in ("row_spot", "row_a", "row_b"))
    plain = [F.to_json(F.struct(quoted(c))) if t.startswith(("map", "variant")) else F.col(quoted(c)) for c, t in df.dtypes]
    held = hashed(df, plain, seed, names)
    rows = copy_numbers(held.select(F.col(spot).alias("spot"), F.col(a).alias("a"), F.col(b).alias("b")))
    places = stored(placed(stored(rows, "numbered"), shards, seed, per_partition, fan), "places")
    places = places.select(F.col("spot").alias(spot), F.col("shard").alias(shard), F.col("slot").alias(slot))
    # the exchange of whole rows: by a merge join at every size
    return held.hint("merge").join(places, spot).select(*[quoted(c) for c in df.columns], shard, slot)


def manifest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law``,
    ``shard``, ``slot``, ``grown_shard`` (null under this law)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffled(stored(narrow, "measured"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED) -> str:
    """Write the shuffled rows as Parquet, one folder per shard, rows of a file in slot order."""
    path = path or folder(df.sparkSession, "shards")
    out = shuffled(df, shards, seed)
    shard, slot = out.columns[-2:]
    step = F.floor(F.col(slot) / PER_PARTITION)
    out.repartition(F.col(quoted(shard)), step).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return path
