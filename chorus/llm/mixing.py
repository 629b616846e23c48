"""Operator 1, mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate, the expected number of its copies. Among all rates below the cap, those
closest to 1 in relative entropy that meet each source's token target have the form
``min(cap, exp(lambda * size / mean size of the source))``. The multipliers lambda maximise the
concave dual and are found by Newton steps, one aggregate over the table of distinct (source, size)
per step, each step stored in the shared folder. A step that leaves its bracket is replaced by a
halving of the bracket. Rates are then rounded into copies so that the sums stay: within a source,
running sums of rates over falling sizes are rounded, with the best of ``OFFSETS`` starting points, and ``REPAIRS`` single copies then close the gap that is left.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words; a
target above ``CAP`` times its source's words stops there and the excess is shared again by weight.

Defined results: a null or empty text has size 0, rate 1 and takes no words; a source without words
has target 0; null is a source of its own; documents of equal source and size are told apart by a
hash of doc_id, repeated rows being interchangeable; an empty table gives an empty result; extra
columns travel along in ``mixed`` and working columns never clash with them.

Scale: the text is read to count words, nothing else of it moves. Tables that grow with the data are
grouped by (source, size) with partial sums; a hot group of one source and size is ranked in
sub-groups of about ``GROUP`` rows by hash. Windows over a whole source see its distinct sizes only,
whose number is bounded by the longest text. Reruns agree: sums that could depend on the order of
rows only enter after rounding the multipliers to single precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.shared import stored
from chorus.llm.textarrays import fresh, quoted

WEIGHTS = (5, 2, 1)
CAP = 3
OFFSETS = 32
REPAIRS = 3
GROUP = 1024
STEPS = 60
CLOSE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size) with ``rank``, ``weight`` and ``target``.

    Sharing by weight with caps has one fixed point: target = min(cap, weight * level). In the order
    of cap / weight, the level is that of the first source that stays below its cap when all before
    it are at theirs. The windows run over sources, one row each."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", share)
    ranked = ranked.withColumn("most", F.col("source_size").cast("double") * cap)
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every).cast("double") - before) / weight_left)
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    # of the sources that stay below their cap, the first in cap order has the smallest cap / weight
    level = F.min_by(free, F.when(free.isNotNull(), F.struct(F.col("most") / F.col("weight"), F.col("rank")))).over(every)
    return ranked.withColumn("target", F.least("most", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("level", "most")


def _rate(multiplier: Column, x: Column, cap: int) -> Column:
    """min(cap, exp(multiplier * x)) without overflow."""
    return F.when(multiplier * x >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(F.least(multiplier * x, F.lit(50.0))))


def multipliers(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(rank, lam): the dual solution of each source.

    ``sizes`` has (rank, size, n) for sizes above 0, ``goals`` (rank, target, source_size, mean)."""
    wide = sizes.join(goals, "rank").withColumn("x", F.col("size") / F.col("mean")).withColumn("tokens", F.col("n") * F.col("size").cast("double"))
    begin = wide.groupBy("rank").agg(F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.sum(F.col("tokens") * F.col("x")).alias("tx"),
                                     F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("mean").alias("mean"))
    ask = F.log(F.col("target") / F.col("source_size"))
    low = F.when(ask < 0, ask / F.col("x_low")).otherwise(ask / F.col("x_high"))
    typical = F.col("tx") / F.col("source_size")
    high = F.when(ask < 0, ask / typical).otherwise(F.log(F.lit(float(cap))) / F.col("x_low"))
    state = stored(begin.select("rank", "target", "mean", low.alias("lo"), high.alias("hi"), (ask / typical).alias("lam"), F.lit(1.0).alias("off")), "newton")
    narrow = sizes.select("rank", "size", "n")
    for _ in range(STEPS):
        x, lam = F.col("size") / F.col("mean"), F.col("lam")
        tokens = F.col("n") * F.col("size").cast("double")
        rate = _rate(lam, x, cap)
        seen = (narrow.join(state, "rank").groupBy("rank")
                .agg(F.sum(tokens * rate).alias("got"), F.sum(F.when(rate < cap, tokens * x * rate).otherwise(0.0)).alias("slope"),
                     *[F.first(c).alias(c) for c in ("target", "mean", "lo", "hi", "lam")]))
        off = F.log(F.col("got") / F.col("target"))
        lo = F.when(off < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, lam - off * F.col("got") / F.col("slope"))
        middle = F.when(lo * hi > 0, F.signum(lo) * F.sqrt(lo * hi)).otherwise((lo + hi) / 2)
        nxt = F.when(F.abs(off) < CLOSE, lam).when((step > lo) & (step < hi), step).otherwise(middle)
        state = stored(seen.select("rank", "target", "mean", lo.alias("lo"), hi.alias("hi"), nxt.alias("lam"), F.abs(off).alias("off")), "newton")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < CLOSE:
            break
    return state.select("rank", F.col("lam").cast("float").cast("double").alias("lam"))


def plan(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies of each group of equal (source, size): ``sizes`` has (source, size, n) and gives
    (source, size, n, source_size, target, rate, total): ``total`` copies for the n documents."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("filled"))
    goals = stored(targets(sources, cap=cap).withColumn("mean", F.col("source_size") / F.greatest("filled", F.lit(1))), "targets")
    known = stored(sizes.join(goals.select("source", "rank"), sizes["source"].eqNullSafe(goals["source"])).select(sizes["source"], "size", "n", "rank"), "sizes")
    open_goals = goals.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12))))
    lam = multipliers(known.where("size > 0"), open_goals.select("rank", "target", "source_size", "mean"), cap)
    facts = goals.select("rank", "source_size", "target", "mean").join(lam, "rank", "left")
    rate = (F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(cap)))
            .otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap)))
    rated = known.join(facts, "rank").withColumn("rate", rate).drop("lam", "mean")
    falling = Window.partitionBy("rank").orderBy(F.col("size").desc())
    run = F.sum(F.col("n") * F.col("rate")).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    rated = stored(rated.withColumn("upto", run).withColumn("before", F.coalesce(F.lag("upto").over(falling), F.lit(0.0))), "rates")

    def copies(offset: Column | float) -> Column:
        start = offset if isinstance(offset, Column) else F.lit(offset)
        return F.least(F.floor(F.col("upto") + start) - F.floor(F.col("before") + start), F.col("n") * cap)

    offsets = [(k + 0.5) / OFFSETS for k in range(OFFSETS)]
    missed = rated.groupBy("rank").agg(F.first("target").alias("goal"), *[F.sum(copies(o) * F.col("size")).alias(f"got_{k}") for k, o in enumerate(offsets)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"got_{k}") - F.col("goal")).alias("miss"), F.lit(o).alias("offset")) for k, o in enumerate(offsets)]))
    chosen = missed.select("rank", best["offset"].alias("offset"))
    out = rated.join(chosen, "rank").withColumn("total", F.when(F.col("size") == 0, F.col("n")).otherwise(copies(F.col("offset"))))
    # what rounding still misses: in each repair one copy of the size that closes the gap best
    source = Window.partitionBy("rank")
    for _ in range(REPAIRS):
        gap = F.col("target") - F.sum(F.col("total") * F.col("size")).over(source)
        out = out.withColumn("gap", gap)
        room = ((F.col("gap") > 0) & (F.col("total") < F.col("n") * cap)) | ((F.col("gap") < 0) & (F.col("total") > 0))
        left = F.abs(F.abs("gap") - F.col("size"))
        out = out.withColumn("offer", F.when(room & (left < F.abs("gap")), F.struct(left.alias("left"), F.col("size"))))
        out = out.withColumn("total", F.col("total") + F.when(F.col("offer") == F.min("offer").over(source), F.signum("gap").cast("long")).otherwise(0))
    return out.select("source", "size", "n", "source_size", "target", "rate", "total")


def mixed(df: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", cap: int = CAP, names: tuple[str, ...] = ("size", "source_size", "target", "rate", "copies")) -> DataFrame:
    """``df`` with each row's size, source size, target, rate and whole number of copies, under ``names``
    (a name that clashes gets a trailing underscore)."""
    given = df.columns
    names = [fresh(df, n) for n in names]
    held, part, rank, total = (fresh(df, n) for n in ("mix_size", "mix_part", "mix_rank", "mix_total"))
    sized = df.withColumn(held, size)
    groups = sized.groupBy(F.col(quoted(source)).alias("source"), F.col(held).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    table = stored(plan(stored(groups, "groups"), cap).withColumn("parts", (1 + F.floor(F.col("n") / GROUP)).cast("int")), "plan")
    g = table.select(*[F.col(c).alias(f"mix_g_{c}") for c in table.columns])
    joined = sized.join(g, F.col(quoted(source)).eqNullSafe(F.col("mix_g_source")) & (F.col(held) == F.col("mix_g_size")))
    key = F.xxhash64(quoted(doc_id), F.lit(1))
    joined = joined.withColumn(part, F.pmod(F.xxhash64(quoted(doc_id), F.lit(2)), F.col("mix_g_parts")).cast("int"))
    # in groups of several parts: the rows in earlier parts
    tally = joined.where("mix_g_parts > 1").groupBy(F.col("mix_g_source").alias("mix_t_source"), F.col(held).alias("mix_t_size"), F.col(part).alias("mix_t_part")).agg(F.count(F.lit(1)).alias("mix_t_n"))
    earlier = Window.partitionBy("mix_t_source", "mix_t_size").orderBy("mix_t_part").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("mix_t_before", F.coalesce(F.sum("mix_t_n").over(earlier), F.lit(0))).drop("mix_t_n")
    within = Window.partitionBy("mix_g_source", held, part).orderBy(key, quoted(doc_id))
    ranked = joined.withColumn(rank, F.row_number().over(within))
    ranked = ranked.join(tally, F.col("mix_g_source").eqNullSafe(F.col("mix_t_source")) & (F.col(held) == F.col("mix_t_size")) & (F.col(part) == F.col("mix_t_part")), "left")
    extra = F.col("mix_g_total") % F.col("mix_g_n")
    copies = F.floor(F.col("mix_g_total") / F.col("mix_g_n")) + (F.col(rank) + F.coalesce("mix_t_before", F.lit(0)) <= extra).cast("long")
    values = (F.col(held), F.col("mix_g_source_size"), F.col("mix_g_target"), F.col("mix_g_rate"), copies)
    return ranked.select(*[F.col(quoted(c)) for c in given], *[v.alias(n) for v, n in zip(values, names, strict=True)])


def mix_table(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (size times copies),
    then ``source``, ``rate``, ``copies``."""
    narrow = stored(docs.select("doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("words")), "words")
    out = mixed(narrow, F.col("words"), cap=cap)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", F.col("copies").cast("long").alias("copies"))


def mixture(docs: DataFrame, text: str = "text", cap: int = CAP) -> DataFrame:
    """The mix itself: rows of ``docs``, in its columns, each as often as its copies."""
    out = mixed(docs, word_count(F.col(quoted(text))), cap=cap)
    copies, again = out.columns[-1], fresh(out, "again")
    taken = out.where(F.col(copies) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return taken.select(*[F.col(quoted(c)) for c in docs.columns])
