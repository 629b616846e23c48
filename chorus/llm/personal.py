"""Operator 11, personal data: wide generators propose spans, boosted trees judge them, calibrated thresholds decide.

1. Base spans follow fixed patterns and checks per kind (email, ip, card, phone) and always stay.
2. Generators of high recall propose further spans of these kinds, which may overlap base spans and each other: spelled
   or bracketed ``at`` and ``dot``, split addresses, IPv6, cards in other groupings, numbers without a plus sign.
3. Gradient-boosted trees score each proposed span by its format (lengths, digit groups, separators, checksum) and
   context (cue words before it, characters that touch it). They are trained here: spans of the corpus that the base checks
   verify are positive, also respelled and regrouped; spans that the checks refute and made decoys (broken
   checksums, versions, dates, prose) are negative. All distinct spans of the corpus are used: those of equal features are
   counted, and the trees are fitted on the counted rows, each kind weighing the same in all.
4. On all spans whose hash was kept out of the fit, each kind gets the lowest threshold at which at least
   ``PRECISION`` of the spans above it are right; a kind that reaches it nowhere adds nothing.
5. Of overlapping spans the base ones stay; where there is none, the one of the highest score does.

All steps are DataFrame operations and Spark ML's trees; no Python runs in tasks. Texts are read in one pass, which keeps the
matches, their contexts and the lengths between them; positions come from running sums over these narrow rows.

Positions count code points, the end is exclusive. Defined results: a null or empty text has no spans; repeated rows are judged
alike, each on its own, whatever their doc_id; without a verified span of a kind in the corpus the trees learn nothing of it and add
none of it; very long texts are read whole, and patterns take time in proportion to them; an empty table gives no
rows; extra columns travel along in ``redacted``, new names that clash get a trailing underscore.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.shared import stored
from chorus.llm.textarrays import fresh, quoted

KINDS = ["email", "ip", "card", "phone"]
FIT_ROWS = 100_000     # counted rows of a task that fits trees
PRECISION = 0.98
TREES, DEPTH = 12, 4
BEFORE, AFTER = 24, 12

# The fixed patterns, written so that each takes time in proportion to the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_AT = r"(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20?@\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\.|\x20(?:dot|DOT)\x20)"
_DOT4 = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20?\.\x20?|\x20(?:dot|DOT)\x20)"
_HEX = "[0-9A-Fa-f]{1,4}"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{_DOT4}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9])"
          rf"|(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00)?\x20?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])",
}



def _may_match(text: Column) -> dict[tuple[str, bool], Column]:
    """What a text must hold for a pattern to match at all: cheap tests that spare most texts the patterns."""
    digit, sign = F.regexp_like(text, F.lit("[0-9]")), text.contains("@")
    return {("email", False): sign, ("email", True): sign | text.contains(" at ") | text.contains(" AT ") | text.rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]"),
            ("ip", False): digit, ("ip", True): digit | text.contains("::") | text.rlike("(?:[A-Fa-f]{1,4}:){7}"), ("card", False): digit, ("card", True): digit, ("phone", False): digit & text.contains("+"), ("phone", True): digit}


CUES = {
    "email": r"mail|contact|write to|adresse|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|addr|ping|login",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"tel|phone|call|mobil|fax|whatsapp|sms|\bt:|anruf|appel|llam",
}
AGAINST = r"version|\bv\.?\s*$|order|invoice|isbn|issn|serial|section|chapter|\bid\b|\bref|sku|tracking|price|page|figure|build|release|[$€£#=]\s*$"

FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "n_chars", "n_digits", "n_letters", "n_blanks", "n_separators", "n_marks", "longest_group", "shortest_group",
            "n_groups", "at_sign", "spelled", "bracketed", "plus", "double_zero", "leading_zero", "opened", "luhn", "in_range", "cue", "other_cue", "against",
            "touched_before", "touched_after"]


# checks ----------------------------------------------------------------------------------------


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return (digits != "") & (F.aggregate(from_right, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def passes(kind: Column, text: Column) -> Column:
    """The base check of a base match."""
    digits = digits_of(text)
    n = F.length(digits)
    return (F.when(kind == "email", True).when(kind == "ip", text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False)).otherwise(n.between(8, 15)))


# matches ---------------------------------------------------------------------------------------


def _hits(text: Column, kind: str, pattern: str, wide: bool) -> Column:
    """Matches of a pattern: each with the length of the text before it since the last match, and the ends of that text."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("text"))
    each = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), i.alias("at"), F.length(z["gap"]).alias("gap"), z["text"].alias("text"),
        F.right(z["gap"], F.lit(BEFORE)).alias("before"), F.left(z["gap"], F.lit(AFTER)).alias("after")))
    return F.when(_may_match(text)[kind, wide] & text.rlike(pattern), each)


def matched(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Stored: the columns ``keep``, a number ``spot`` for each row, and ``hits``, all matches of all patterns."""
    body = F.col(quoted(text)).cast("string")
    own = docs.select(*[F.col(quoted(c)).alias(f"keep_{i}") for i, c in enumerate(keep)], body.alias("body"))
    found = [_hits(F.col("body"), k, p, w) for w, table in ((False, BASE), (True, WIDE)) for k, p in table.items()]
    hits = F.flatten(F.array_compact(F.array(*found)))
    return stored(own.select(*[F.col(f"keep_{i}") for i in range(len(keep))], F.monotonically_increasing_id().alias("spot"), hits.alias("hits")), "matches")


def spans_of(found: DataFrame) -> DataFrame:
    """Stored: ``spot``, ``kind``, ``wide``, ``start``, ``end``, ``text``, ``before``, ``after``, ``base`` of every match."""
    rows = found.select("spot", F.inline("hits"))
    run = Window.partitionBy("spot", "kind", "wide").orderBy("at")
    length = F.coalesce(F.length("text"), F.lit(0))
    placed = rows.withColumn("end", F.sum(F.col("gap") + length).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("after").over(run))
    whole = placed.where("text is not null").select("spot", "kind", "wide", (F.col("end") - length).alias("start"), "end", "text", "before", F.col("next").alias("after"))
    return stored(whole.withColumn("base", F.when(F.col("wide"), False).otherwise(passes(F.col("kind"), F.col("text")))).where("wide or base"), "spans")


# features and training -------------------------------------------------------------------------


def with_features(spans: DataFrame) -> DataFrame:
    """``spans`` (kind, text, before, after) with FEATURES."""
    text, before, after = F.col("text"), F.lower("before"), F.col("after")
    digits = digits_of(text)
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    own = F.lit(False)
    any_cue = F.lit(False)
    for kind, cue in CUES.items():
        own = F.when(F.col("kind") == kind, before.rlike(cue)).otherwise(own)
        any_cue = any_cue | (before.rlike(cue) & (F.col("kind") != kind))
    flag = {
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
        "at_sign": text.contains("@"), "spelled": text.rlike(r"(?i)(?<![a-z])(?:at|dot)(?![a-z])"), "bracketed": text.rlike(r"[\[\](){}]"),
        "plus": text.startswith("+"), "double_zero": text.startswith("00"), "leading_zero": text.rlike(r"^\(?0"), "opened": text.contains("("),
        "luhn": luhn(digits), "in_range": F.forall(groups, lambda g: (F.length(g) <= 3) & (g.cast("int") <= 255)),
        "cue": own, "other_cue": any_cue, "against": before.rlike(AGAINST), "touched_before": before.rlike(r"[^\s:(\"'<]$"), "touched_after": after.rlike(r"^[^\s.,;:!?)\"'>]")}
    number = {
        "n_chars": F.length(text), "n_digits": F.length(digits), "n_letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")), "n_blanks": F.length(F.regexp_replace(text, r"\S", "")),
        "n_separators": F.length(F.regexp_replace(text, r"[A-Za-z0-9\s]", "")), "n_marks": F.size(F.array_distinct(F.split(F.regexp_replace(text, r"[A-Za-z0-9]", ""), ""))),
        "longest_group": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest_group": F.coalesce(F.array_min(sizes), F.lit(0)), "n_groups": F.size(groups)}
    made = {**{k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in flag.items()}, **{k: v.cast("double") for k, v in number.items()}}
    return spans.withColumns({k: made[k] for k in FEATURES})


def _chosen(spans: DataFrame) -> DataFrame:
    """The distinct spans that the checks verify, and those that they refute."""
    text, kind = F.col("text"), F.col("kind")
    digits = digits_of(text)
    verified = (F.when(kind == "email", text.rlike(f"^{BASE['email']}$")).when(kind == "ip", text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
                .when(kind == "card", text.rlike(r"^[0-9](?:[\x20-]?[0-9]){15,18}$") & luhn(digits)).otherwise(text.rlike(r"^\+") & F.length(digits).between(8, 15)))
    refuted = (F.when(kind == "card", ~luhn(digits)).when(kind == "ip", text.rlike(r"^[0-9.]+$") & ~text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).otherwise(False))
    marked = spans.where("wide").select("kind", "text", "before", "after", verified.alias("right")).where(F.col("right") | refuted).distinct()
    return marked.withColumn("hash", F.xxhash64("kind", "text"))


def _examples(chosen: DataFrame) -> DataFrame:
    """Labelled spans: the chosen ones, and the verified ones respelled (label 1) or broken (label 0)."""
    text, before, after = F.col("text"), F.col("before"), F.col("after")
    digits = digits_of(text)
    spaced = lambda mark: F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", f"$1{mark}")
    broken = F.concat(digits.substr(F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1 + F.abs(F.col("hash")) % 9) % 10).cast("string"))
    last = lambda n: F.right(digits, F.lit(n))
    local, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    word = F.coalesce(F.nullif(F.regexp_extract(before, r"([A-Za-z]+)\W*$", 1), F.lit("")), F.lit("look"))
    parts = F.split(text, r"\.")
    small = F.array_join(F.transform(parts, lambda p: F.right(p, F.lit(1))), ".")
    phone = F.regexp_replace(text, r"^\+[0-9]{1,3}[\x20-]", "")

    made = {
        "email": [(1, F.concat(local, F.lit(a), F.replace(host, F.lit("."), F.lit(d)))) for a, d in ((" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) "), (" @ ", "."), (" [at] ", "[dot]"))]
                 + [(0, F.concat(word, F.lit(" at "), F.regexp_extract(host, "[A-Za-z]+", 0), F.lit("."), word)), (0, F.concat(word, F.lit(" at "), word, F.lit(" dot "), word))],
        "ip": [(1, F.replace(text, F.lit("."), F.lit(d))) for d in ("[.]", " . ", "(dot)", " dot ")]
              + [(0, F.concat(F.lit("4"), F.right(text, F.length(text)))), (0, F.replace(F.replace(text, F.lit("."), F.lit(".9")), F.lit(".99"), F.lit(".98")))],
        "card": [(1, spaced(m)) for m in (".", "/", "  ", "_", "-", " ")] + [(0, broken), (0, F.regexp_replace(broken, r"([0-9]{4})(?=[0-9])", "$1."))]
                + [(0, F.regexp_replace(broken, r"([0-9]{4})(?=[0-9])", "$1 "))],
        "phone": [(1, F.regexp_replace(text, r"^\+", "00")), (1, F.regexp_replace(text, r"[\x20()]+", "."))]
                 + [(0, last(7)), (0, last(10)), (0, F.concat(F.lit("20"), last(2), F.lit("-0"), F.right(last(4), F.lit(1)), F.lit("-1"), F.left(last(2), F.lit(1)))),
                    (0, F.concat(last(3), F.lit("."), last(6))), (0, F.concat(last(4), F.lit("-"), last(4), F.lit(" "), last(3)))],
    }
    cued = {"phone": [(1, "tel. ", phone), (1, "call ", phone), (1, "phone: ", last(10)), (0, "order ", phone), (0, "isbn ", phone)],
            "email": [(1, "mail: ", F.concat(local, F.lit(" at "), host))],
            "ip": [(0, "version ", small), (0, "section ", small), (1, "ip ", F.replace(text, F.lit("."), F.lit(" . ")))],
            "card": [(0, "order ", broken), (0, "serial ", broken), (1, "visa ", spaced("."))]}
    each = F.array(F.struct(F.lit(1).alias("label"), before.alias("before"), text.alias("text")))
    for kind in KINDS:
        rows = [F.struct(F.lit(label).alias("label"), before.alias("before"), v.alias("text")) for label, v in made[kind]]
        rows += [F.struct(F.lit(label).alias("label"), F.lit(cue).alias("before"), v.alias("text")) for label, cue, v in cued[kind]]
        each = F.when(F.col("kind") == kind, F.concat(F.array(F.struct(F.lit(1).alias("label"), before.alias("before"), text.alias("text"))), F.array(*rows))).otherwise(each)
    wrong = F.array(F.struct(F.lit(0).alias("label"), before.alias("before"), text.alias("text")))
    return chosen.select("kind", "after", "hash", F.inline(F.when(F.col("right"), each).otherwise(wrong)))


class Judge:
    """Fitted trees and the threshold of each kind."""

    def __init__(self, model: GBTClassificationModel | None, thresholds: dict[str, float]):
        self.model, self.thresholds = model, thresholds

    def scored(self, spans: DataFrame) -> DataFrame:
        """``spans`` with ``score``, from 0 to 1."""
        if self.model is None:
            return spans.withColumn("score", F.lit(0.0))
        held = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(spans))
        return self.model.transform(held).withColumn("score", vector_to_array("probability")[1]).select(*spans.columns, "score")

    def accepted(self, scored: DataFrame) -> DataFrame:
        """The spans whose score reaches their kind's threshold."""
        ok = F.lit(False)
        for kind, least in self.thresholds.items():
            ok = ok | ((F.col("kind") == kind) & (F.col("score") >= least))
        return scored.where(ok)


def calibrated(scored: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the lowest score in steps of 0.01 from which on at least ``precision`` of the labelled spans are right; ``n``: spans of a row."""
    step = F.least(F.floor(F.col("score") * 100), F.lit(99))
    tally = scored.groupBy("kind", step.alias("step")).agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("step"))
    share = F.sum("right").over(above) / F.sum("n").over(above)
    good = tally.withColumn("share", share).where((F.col("share") >= precision) & (F.col("right") > 0)).groupBy("kind").agg(F.min("step").alias("step"))
    return {r.kind: max(r.step / 100, 0.5) for r in good.collect()}


def counted(spans: DataFrame) -> DataFrame:
    """Stored: the examples of all spans by ``kind``, ``label``, ``held`` (kept out of the fit) and FEATURES, with their number ``n``."""
    rows = with_features(_examples(_chosen(spans)).where("text is not null")).withColumn("held", F.pmod("hash", F.lit(4)) == 0)
    return stored(rows.groupBy("kind", "label", "held", *FEATURES).agg(F.count(F.lit(1)).alias("n")), "examples")


def train(spans: DataFrame, precision: float = PRECISION) -> Judge:
    """Fit the trees on spans of the corpus: three quarters of the hashes fit them, the others set the thresholds."""
    examples = counted(spans)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fit_on = examples.where("not held")
    size = fit_on.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("labels")).first()
    if size.labels < 2:
        return Judge(None, {})
    # in a fixed order, so that reruns fit the same trees; beyond FIT_ROWS, sums of several tasks may differ in their last bits
    own = fit_on.join(F.broadcast(fit_on.groupBy("kind").agg(F.sum("n").alias("all"))), "kind").withColumn("weight", F.col("n") / F.col("all") * size.rows)
    own = own.repartition(-(-size.rows // FIT_ROWS), *FEATURES).sortWithinPartitions("kind", *FEATURES, "label")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=11, checkpointInterval=-1)
    model = trees.fit(assembler.transform(own).select("features", F.col("label").cast("double").alias("label"), "weight"))
    known = model.transform(assembler.transform(examples.where("held"))).withColumn("score", vector_to_array("probability")[1])
    return Judge(model, calibrated(known.select("kind", "label", "n", "score"), precision))


# selection -------------------------------------------------------------------------------------


def selected(spans: DataFrame, judge: Judge) -> DataFrame:
    """``spot``, ``kind``, ``start``, ``end``, ``base``, ``score`` of the spans that stay, and ``cluster``, the start of the spans
    that overlap them."""
    columns = ["spot", "kind", "start", "end", "base"]
    added = judge.accepted(judge.scored(spans.where("wide").select("spot", "kind", "start", "end", "base", "text", "before", "after")))
    every = spans.where("base").select(*columns, F.lit(1.0).alias("score")).unionByName(added.select(*columns, "score"))
    before = Window.partitionBy("spot").orderBy("start", "end", "kind", "base").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True))
    upto = Window.partitionBy("spot").orderBy("start", "end", "kind", "base").rowsBetween(Window.unboundedPreceding, 0)
    grouped = every.withColumn("opens", F.when(opens, F.col("start"))).withColumn("cluster", F.max("opens").over(upto)).drop("opens")
    best = Window.partitionBy("spot", "cluster").orderBy(F.desc("base"), F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    return grouped.withColumn("place", F.row_number().over(best)).where("base or place = 1").drop("place")


def listed(rows: Column) -> Column:
    """kind:start:end of an array of (kind number, start, end), by kind as listed, then start."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(F.sort_array(rows), lambda r: F.concat_ws(":", name(r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")


def personal(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Per document: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` of the base spans, ``spans`` (all
    that stay) and ``n_added``."""
    found = matched(docs, ["doc_id"])
    spans = spans_of(found)
    kept = selected(spans, train(spans, precision))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    row = F.struct(number.cast("int").alias("kind"), F.col("start"), F.col("end"))
    per_row = kept.groupBy("spot").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), row)).alias("base"), F.collect_list(row).alias("every"), F.count(F.when(~F.col("base"), 1)).alias("n_added"))
    out = found.select(F.col("keep_0").alias("doc_id"), "spot").join(per_row, "spot", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
                      F.sha2(listed(F.coalesce("base", none)), 256).alias("base_sha256"), listed(F.coalesce("every", none)).alias("spans"), F.coalesce("n_added", F.lit(0).cast("long")).alias("n_added"))


def redacted(df: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``df``, stored once, with ``redacted``: its text with overlapping spans replaced together by their first kind in brackets."""
    name, spot = fresh(df, "redacted"), fresh(df, "spot")
    held = stored(df.withColumn(spot, F.monotonically_increasing_id()), "texts")
    found = matched(held, [spot], text)
    spans = spans_of(found)
    runs = selected(spans, train(spans, precision)).groupBy("spot", "cluster").agg(F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"), F.max("end").alias("end"))
    rows = runs.groupBy("spot").agg(F.sort_array(F.collect_list(F.struct(F.col("cluster").alias("start"), "end", "kind"))).alias("runs"))
    rows = found.join(rows, "spot").select(F.col("keep_0").alias("own_spot"), "runs")
    body = F.col(quoted(text)).cast("string")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda s, r: F.struct(F.concat(s["done"], body.substr(s["at"].cast("int") + 1, (r["start"] - s["at"]).cast("int")), F.lit("["), F.upper(r["kind"]), F.lit("]")).alias("done"), r["end"].alias("at"))
    cut = F.aggregate("runs", start, step, lambda s: F.concat(s["done"], body.substr(s["at"].cast("int") + 1, F.length(body))))
    joined = held.join(rows, F.col(quoted(spot)) == F.col("own_spot"), "left")
    return joined.select(*[F.col(quoted(c)) for c in df.columns], F.when(F.col("runs").isNull(), body).otherwise(cut).alias(name))
