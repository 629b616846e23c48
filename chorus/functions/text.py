"""Column expressions for text rules: question type, difficulty, weakness categories, Python-style
strip and word count, judge-reply JSON extraction and critique parsing.

All of these are built-in Spark expressions (JVM side, no Python UDF). Rule data comes from
``rules.py``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorus.functions import rules as R


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(text) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends (Spark ``trim`` only spaces)."""
    ws = R.PY_WHITESPACE_CLASS
    return F.regexp_replace(_c(text), f"^{ws}+|{ws}+$", "")


def py_word_count(text) -> Column:
    """``len(text.split())``: number of runs of non-whitespace characters."""
    parts = F.split(_c(text), f"{R.PY_WHITESPACE_CLASS}+")
    return F.size(F.filter(parts, lambda p: p != F.lit("")))


def char_count(text, ch: str) -> Column:
    """Occurrences of one character."""
    t = _c(text)
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def _any_substring(lowered: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def classify_question(query) -> Column:
    """first rule of the question-type table whose words occur in the lowercased query."""
    return classify_lowered(F.lower(_c(query)))


def classify_lowered(q: Column) -> Column:
    """F1 on an already lowercased column (lowercase once, test many words)."""
    expr = None
    for qtype, words in R.QUESTION_TYPE_RULES:
        cond = _any_substring(q, words)
        expr = F.when(cond, F.lit(qtype)) if expr is None else expr.when(cond, F.lit(qtype))
    return expr.otherwise(F.lit(R.DEFAULT_QUESTION_TYPE))


def difficulty_signals(query) -> tuple[Column, Column]:
    """F2 parts: (hard signal count, easy signal count)."""
    raw = _c(query)
    q = F.lower(raw)
    words = py_word_count(raw)
    hard = [
        words > R.HARD_WORD_LIMIT,
        q.contains("step by step"),
        q.contains("compare") & q.contains("and"),
        _any_substring(q, R.HARD_TERMS),
        char_count(raw, "?") > 1,
    ]
    easy = [words < R.EASY_WORD_LIMIT, _any_substring(q, R.EASY_TERMS)]
    as_int = lambda conds: reduce(lambda a, b: a + b, [c.cast("int") for c in conds])
    return as_int(hard), as_int(easy)


def estimate_difficulty(query) -> Column:
    """hard signals minus easy signals -> expert / hard / medium / trivial / easy."""
    hard, easy = difficulty_signals(query)
    score = hard - easy
    return (
        F.when(score >= 3, "expert")
        .when(score >= 2, "hard")
        .when(score >= 1, "medium")
        .when(easy >= 2, "trivial")
        .otherwise("easy")
    )


def category_regex(patterns) -> str:
    """One alternation per category. ``(?d)``: '.' stops only at '\\n', as in Python."""
    return "(?d)(" + "|".join(patterns) + ")"


_REGEX_META = set(".^$*+?{}[]\\|()")


def category_condition(lowered: Column, patterns) -> Column:
    """A category applies when any of its patterns is found. Plain words are substring tests
    (a search for a literal pattern is exactly that); only patterns with metacharacters go
    through the regex engine, after the cheap tests."""
    plain = [p for p in patterns if not (set(p) & _REGEX_META)]
    rx = [p for p in patterns if set(p) & _REGEX_META]
    cond = _any_substring(lowered, plain) if plain else F.lit(False)
    return cond | lowered.rlike(category_regex(rx)) if rx else cond


def categorize_query(query) -> Column:
    """multi-label weakness categories in declared order, ``["general"]`` when none apply."""
    return categorize_lowered(F.lower(_c(query)))


def categorize_lowered(q: Column) -> Column:
    """F3 on an already lowercased column. ``concat_ws`` skips NULLs, so the joined hits are split
    back into the ordered list; unlike a lambda filter over an array, every step here stays
    inside generated code."""
    joined = F.concat_ws(",", *[F.when(category_condition(q, p), F.lit(cat)) for cat, p in R.WEAKNESS_CATEGORIES])
    return F.when(joined == "", F.array(F.lit(R.DEFAULT_CATEGORY))).otherwise(F.split(joined, ","))


def lookup(key, table, default=None) -> Column:
    """CASE over a small fixed (key, value) table."""
    k = _c(key)
    expr = None
    for kk, vv in table:
        expr = F.when(k == kk, F.lit(vv)) if expr is None else expr.when(k == kk, F.lit(vv))
    return expr.otherwise(F.lit(default))


def route_temperature(question_type) -> Column:
    """F5."""
    return lookup(question_type, R.TEMPERATURE_BY_TYPE, R.DEFAULT_TEMPERATURE)


def route_depth(difficulty) -> Column:
    """F6."""
    return lookup(difficulty, R.DEPTH_BY_DIFFICULTY, "standard")


def route_confidence(type_count) -> Column:
    """min(0.95, 0.3 + n / 50 * 0.65)."""
    n = F.coalesce(_c(type_count), F.lit(0)).cast("double")
    return F.least(
        F.lit(R.ROUTER_CONFIDENCE_CAP),
        F.lit(R.ROUTER_CONFIDENCE_BASE) + n / F.lit(float(R.ROUTER_CONFIDENCE_FULL_AT)) * F.lit(R.ROUTER_CONFIDENCE_SPAN),
    )


def use_meta_reasoning(question_type, difficulty) -> Column:
    """F8."""
    return _c(difficulty).isin(R.META_REASONING_DIFFICULTIES) | _c(question_type).isin(R.META_REASONING_TYPES)


def py_fixed(x, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"``. ``format_number`` rounds half-even on the exact binary value
    (as Python does); ``format_string``/``bround`` would round the shortest decimal form, which
    differs on values such as 0.175. Grouping commas are removed."""
    return F.replace(F.format_number(_c(x), digits), F.lit(","), F.lit(""))


def py_round(x, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles (half-even on the exact binary value)."""
    return py_fixed(x, digits).cast("double")


def percent0(x) -> Column:
    """Python ``f"{x:.0%}"``: x*100 formatted with no decimals, then '%'."""
    return F.concat(py_fixed(_c(x) * 100, 0), F.lit("%"))


# --- judge reply parsing (F11, F12) ------------------------------------------------------------

JUDGE_SCORES_TYPE = (
    "ARRAY<STRUCT<model_index: DOUBLE, accuracy: DOUBLE, completeness: DOUBLE, "
    "reasoning_quality: DOUBLE, clarity: DOUBLE>>"
)


def extract_judge_json(text) -> Column:
    """the whole text as JSON; else the first ```json fence; else the first bare fence; else
    the greedy outer braces; else NULL. Returns a VARIANT."""
    t = _c(text)
    candidates = [
        t,
        F.regexp_extract(t, r"(?s)```json\s*(.*?)\s*```", 1),
        F.regexp_extract(t, r"(?s)```\s*(.*?)\s*```", 1),
        F.regexp_extract(t, r"(?s)(\{.*\})", 1),
    ]
    return F.coalesce(*[F.try_parse_json(c) for c in candidates])


_NUMERIC_KINDS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL|BOOLEAN)"


def _json_number(v: Column, path: str) -> Column:
    """A field as a double only when it is a JSON number (or boolean, which Python treats as 1/0);
    strings and other kinds give NULL."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x).rlike(_NUMERIC_KINDS), F.try_variant_get(x, "$", "double"))


def judge_fields(variant) -> Column:
    """struct of scores, consensus [] , disagreements [], confidence (0.5 when missing).
    Score fields count only when they are JSON numbers."""
    v = _c(variant)
    obj = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    raw = F.try_variant_get(obj, "$.scores", "array<variant>")
    fields = ["model_index", "accuracy", "completeness", "reasoning_quality", "clarity"]
    scores = F.transform(raw, lambda s: F.struct(*[_json_number(s, f"$.{f}").alias(f) for f in fields]))
    return F.struct(
        scores.alias("scores"),
        F.coalesce(F.try_variant_get(obj, "$.consensus_points", "array<string>"), F.array().cast("array<string>")).alias("consensus_points"),
        F.coalesce(F.try_variant_get(obj, "$.disagreement_points", "array<string>"), F.array().cast("array<string>")).alias("disagreement_points"),
        F.coalesce(F.try_variant_get(obj, "$.confidence", "double"), F.lit(0.5)).alias("confidence"),
    )


# --- critique and verification parsing (F16, F17, F18) -----------------------------------------

def _first_int_over_100(line: Column) -> Column:
    digits = F.regexp_extract(line, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("decimal(38,0)").cast("double") / 100.0)


def parse_critique(text) -> Column:
    """F16: struct(confidence, issues). Issues: stripped lines containing 'critical' or 'major'.
    Confidence folds over lines from 0.7: a 'confidence' line with an integer sets n/100, a clean
    phrase lifts it to at least 0.85. Not capped."""
    lines = F.split(_c(text), "\n")
    issues = F.transform(
        F.filter(lines, lambda ln: _any_substring(F.lower(ln), R.CRITIQUE_ISSUE_WORDS)),
        lambda ln: py_strip(ln),
    )

    def step(acc, ln):
        low = F.lower(ln)
        value = _first_int_over_100(ln)
        after_conf = F.when(low.contains("confidence") & value.isNotNull(), value).otherwise(acc)
        clean = _any_substring(low, R.CRITIQUE_CLEAN_PHRASES)
        return F.when(clean, F.greatest(after_conf, F.lit(R.CRITIQUE_CLEAN_FLOOR))).otherwise(after_conf)

    conf = F.aggregate(lines, F.lit(R.CRITIQUE_START_CONFIDENCE), step)
    return F.struct(conf.alias("confidence"), issues.alias("issues"))


def parse_verification(text) -> Column:
    """the last 'confidence' line holding an integer wins, from 0.7, capped at 1."""
    lines = F.split(_c(text), "\n")

    def step(acc, ln):
        value = _first_int_over_100(ln)
        return F.when(F.lower(ln).contains("confidence") & value.isNotNull(), value).otherwise(acc)

    return F.least(F.lit(1.0), F.aggregate(lines, F.lit(R.CRITIQUE_START_CONFIDENCE), step))


def needs_refinement(verification_confidence, issues) -> Column:
    """refine unless verification > 0.85 and no issues were found."""
    return ~((_c(verification_confidence) > R.REFINE_CONFIDENCE_ABOVE) & (F.coalesce(F.size(_c(issues)), F.lit(0)) == 0))
