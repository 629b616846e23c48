"""Operator 3, quality rules: a threshold table compiled into one projection.

``RULES`` is a table of (name, metric, bound, threshold). ``compiled`` turns it into one projection of
built-in expressions: the metrics of every whole text, one boolean per rule, and the verdict. No user
function runs and nothing is shuffled.

Words are runs of characters other than white space. Repeated words are those in an eight-word window
that occurs twice or more in the text; window hashes are compared first, and only texts in which two
hashes agree compare the windows themselves.

Defined results: a null or empty text has all counts zero and fails the base rule; a text of fewer
than eight words has no window; a ratio with denominator zero is zero; repeated rows are judged
alike; very long texts are read whole; an empty table gives an empty result; extra columns travel
along in ``compiled`` and names that clash get a trailing underscore on the new column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.textarrays import fresh, quoted

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = ["the", "of", "and", "to", "a", "in", "is", "that", "for", "on", "with", "as", "this", "was", "it",
              "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "im", "nicht", "des",
              "le", "la", "les", "de", "et", "un", "une", "que", "dans", "pour", "est", "du", "en", "au",
              "el", "los", "las", "y", "por", "con", "una", "para", "se", "del"]

# The threshold table: a text fails a rule if its metric lies outside the bound.
RULES = [
    ("enough_words", "n_words", "min", 20),
    ("repeated_words", "repeat_share", "max", 0.30),
    ("mean_word_length", "mean_word", "min", 2.0),
    ("long_words", "mean_word", "max", 12.0),
    ("symbols", "symbol_share", "max", 0.10),
    ("duplicate_lines", "dup_line_share", "max", 0.30),
    ("stop_words", "stop_share", "min", 0.02),
    ("distinct_words", "distinct_share", "min", 0.01),
    ("exclaimed_words", "exclaimed_share", "max", 0.10),
]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, windows: Column) -> Column:
    """Words covered by windows that occur twice or more; ``windows`` holds one hash per window."""
    at = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    ordered = _with(words, lambda held: F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(held, i, F.lit(WINDOW)), " ").alias("w"), i.alias("p")))))

    def starts(o: Column) -> Column:
        """Starts of the windows that equal a neighbour in sorted order, back in text order."""
        none = F.array(F.lit(None).cast("struct<w:string,p:int>"))
        near = F.arrays_zip(o.alias("o"), F.concat(none, F.slice(o, 1, F.size(o) - 1)).alias("b"), F.concat(F.slice(o, 2, F.size(o)), none).alias("a"))
        same = F.filter(near, lambda z: (z["o"]["w"] == z["b"]["w"]) | (z["o"]["w"] == z["a"]["w"]))
        return F.sort_array(F.transform(same, lambda z: z["o"]["p"]))

    def covered(s: Column) -> Column:
        gaps = F.transform(F.arrays_zip(s.alias("p"), F.slice(s, 2, F.size(s)).alias("q")), lambda z: F.least(F.lit(WINDOW), F.coalesce(z["q"] - z["p"], F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda n, g: n + g)

    twice = F.size(F.array_distinct(windows)) < F.size(words) - (WINDOW - 1)
    return F.when(twice, _with(_with(ordered, starts), covered)).otherwise(F.lit(0)).cast("long")


def compiled(df: DataFrame, rules: list[tuple[str, str, str, float]] = RULES, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``kept`` and ``failed`` (names of the failed rules)."""
    work, hashes, out = fresh(df, "rule_words"), fresh(df, "rule_hashes"), fresh(df, "rule_out")
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    inner = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))
    n = F.size(work)
    window_hashes = F.when(n >= WINDOW, _with(F.col(hashes), lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(n >= WINDOW, repeated_words(F.col(work), window_hashes)).otherwise(F.lit(0)).cast("long"),
        "n_lines": F.size(lines),
        "n_stop": F.size(F.filter(F.col(work), lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_distinct": F.size(F.array_distinct(F.col(hashes))),
        "n_exclaimed": F.regexp_count(body, F.lit(r"!(?=[\x20\x09-\x0D]|\z)")),
    }
    measured = (df.withColumn(work, words).withColumn(hashes, F.transform(F.col(work), lambda w: F.xxhash64(w)))
                .withColumn(out, F.struct(*[v.alias(k) for k, v in facts.items()])))
    f = {k: F.col(f"{quoted(out)}.{k}") for k in facts}
    metrics = {
        "n_words": f["n_words"], "mean_word": _share(f["word_chars"], f["n_words"]), "symbol_share": _share(f["n_symbols"], f["n_words"]),
        "dup_line_share": _share(f["n_dup_lines"], f["n_lines"]), "repeat_share": _share(f["n_repeat_words"], f["n_words"]),
        "stop_share": _share(f["n_stop"], f["n_words"]), "distinct_share": _share(f["n_distinct"], f["n_words"]),
        "exclaimed_share": _share(f["n_exclaimed"], f["n_words"]),
    }
    fails = {name: metrics[metric] < least if bound == "min" else metrics[metric] > least for name, metric, bound, least in rules}
    base = (f["n_words"] < 20) | (f["n_repeat_words"] * 100 > f["n_words"] * 30)
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in fails.items()]))
    kept = ~base
    for c in fails.values():
        kept = kept & ~c
    new = {**{k: f[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "base_failed": base, "kept": kept, "failed": failed}
    return measured.select(*[F.col(quoted(c)) for c in df.columns], *[v.alias(fresh(df, k)) for k, v in new.items()])


def judged(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, the counts, ``base_failed`` and ``kept``."""
    out = compiled(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed").alias("failed"))
