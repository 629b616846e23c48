"""Operator 8, quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics (lengths, character classes, repetition of words, lines
and word pairs, stop words of four languages). Trees are grown on binned statistics with gradient
histograms for the logistic loss, then flattened into arrays (feature, cut, leaf value, in heap
order) that score a batch of documents level by level.

The classifier is fitted on at most ``SAMPLE`` labelled documents, those whose hashed doc_id is
smallest; this is the only bounded step. Every document is scored, in one pass without a shuffle.

Defined results: a null text counts as empty; an empty text has all statistics zero and is scored
like any other; a null doc_id is scored but never learned from and is not held out; conflicting or
repeated labels of one doc_id count as their mean, 0.5 or more being label 1; without a usable label
every score is 0.5. Repeated documents get equal scores; extra columns travel along in ``scored``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.textarrays import SPACED, Words, fresh, map_texts, mix64, quoted

SAMPLE = 20_000
CUT = 0.7
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 60, 0.15, 1.0, 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """the of and to a in is it that was for on are as with his they at be this from have or by one had not but what
all were when we there can an der die das und ist nicht ein eine zu den von mit sich auf für im dem des es als auch
le la les de et des un une en est que qui dans pour pas au sur par du el los las y se no con su por para una lo""".split()

STATISTICS = ["log_words", "log_bytes", "word_length", "upper", "digit", "symbol", "punctuation", "beyond_ascii", "line_breaks",
              "distinct_words", "repeated_next", "distinct_pairs", "distinct_fours", "top_word", "stop_words", "exclaimed", "barred",
              "duplicate_lines", "long_words", "lone_symbols"]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _POINT = _class("#*$%&|<>=+^~@\\{}[]_"), _class(".,;:!?'\"()-")
_BEYOND = np.arange(256) >= 0xC0


def _hash_words(words: list[str]) -> np.ndarray:
    data = [w.encode("utf-8") for w in words]
    offs = np.cumsum([0, *(len(w) for w in data)])
    return np.sort(Words(np.frombuffer(b"".join(data), np.uint8), offs, SPACED).hashes)


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk."""
    words = Words(buf, offs, SPACED)
    n = len(offs) - 1
    size = np.diff(offs)
    count = words.counts
    per = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[buf])))[offs])
    chars = np.maximum(size, 1)
    some = np.maximum(count, 1)
    out = np.zeros((n, len(STATISTICS)), np.float64)
    lengths = words.ends - words.starts
    over_words = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[words.first])
    stops = _hash_words(sorted(set(STOP_WORDS)))
    spot = np.searchsorted(stops, words.hashes)
    spot[spot == len(stops)] = 0
    last = buf[words.ends - 1] if len(lengths) else np.zeros(0, np.uint8)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buf])))
    breaks = per(_class("\n"))
    out[:, 0], out[:, 1] = np.log1p(count), np.log1p(size)
    out[:, 2] = over_words(lengths) / some
    for k, table in ((3, _UPPER), (4, _DIGIT), (5, _SYMBOL), (6, _POINT), (7, _BEYOND)):
        out[:, k] = per(table) / chars
    out[:, 8] = breaks / some
    out[:, 14] = over_words(stops[spot] == words.hashes) / some
    out[:, 15] = over_words(last == ord("!")) / some
    out[:, 16] = per(_class("|")) / some
    out[:, 18] = over_words(lengths > 20) / some
    out[:, 19] = over_words(symbols[words.ends] > symbols[words.starts]) / some
    hashes, low = words.hashes, words.low
    lines = _line_starts(buf, offs)
    for t in np.flatnonzero(count).tolist():
        own = hashes[words.first[t] : words.first[t + 1]]
        m = len(own)
        _, seen = np.unique(own, return_counts=True)
        out[t, 9], out[t, 13] = len(seen) / m, seen.max() / m
        if m > 1:
            out[t, 10] = np.count_nonzero(own[1:] == own[:-1]) / (m - 1)
            out[t, 11] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / (m - 1)
        if m > 3:
            four = mix64(own[3:] + own[2:-1] * np.uint64(5) + own[1:-2] * np.uint64(25) + own[:-3] * np.uint64(125))
            out[t, 12] = len(np.unique(four)) / (m - 3)
        if breaks[t]:
            at = lines[np.searchsorted(lines, offs[t]) : np.searchsorted(lines, offs[t + 1])]
            raw = [bytes(x) for x in np.split(low[offs[t] : offs[t + 1]], at[1:] - offs[t])]
            kept = [x for x in raw if any(x)]
            out[t, 17] = 1 - len({x.rstrip(b"\0") for x in kept}) / len(kept) if kept else 0
    return out


def _line_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate((offs[:-1][np.diff(offs) > 0], np.flatnonzero(buf == 10)[:] + 1)))


class Trees:
    """Boosted trees as arrays: node k of a tree has children 2k + 1 and 2k + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Second-order boosting for the logistic loss; every split is the best over all bin borders."""
    inner, n, width = 2**depth - 1, len(x), x.shape[1] if len(x) else len(STATISTICS)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 2**depth))
    if not n or share in (1e-3, 1 - 1e-3):
        return Trees(base, feature[:0], cut[:0], leaf[:0])
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(borders[f], x[:, f], side="left") for f in range(width)], 1) + np.arange(width) * bins
    margin = np.full(n, base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            slot = (node - first)[:, None] * (width * bins) + codes
            sums = [np.bincount(slot.ravel(), np.repeat(v, width), wide * width * bins).reshape(wide, width, bins) for v in (grad, hess, np.ones(n))]
            left_g, left_h, left_n = (np.cumsum(s, 2) for s in sums)
            all_g, all_h, all_n = (s[:, :, -1:] for s in (left_g, left_h, left_n))
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_n < LEAST) | (all_n - left_n < LEAST)] = 0
            flat = gain.reshape(wide, -1)
            best = flat.argmax(1)
            for j in range(wide):
                f, b = divmod(int(best[j]), bins)
                if flat[j, best[j]] > 1e-9 and b < len(borders[f]):
                    feature[k, first + j], cut[k, first + j] = f, borders[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > cut[k, node])
        g = np.bincount(node - inner, grad, 2**depth)
        h = np.bincount(node - inner, hess, 2**depth)
        leaf[k] = RATE * g / (h + RIDGE)
        margin += leaf[k][node - inner]
    return Trees(base, feature, cut, leaf)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from: crc32 of the decimal doc_id leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents (``docs``: doc_id, text; ``labels``: doc_id, quality)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    field = T.StructField("x", T.ArrayType(T.DoubleType()))
    rows = map_texts(own, "text", [field], _rows, ["doc_id", "y"])
    got = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit(np.array([r.x for r in got]).reshape(len(got), len(STATISTICS)), np.array([r.y for r in got]))


def _rows(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    x = statistics(buf, offs)
    return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))]


def scored(docs: DataFrame, model: Trees, keep: list[str] | None = None, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` (its columns ``keep``) with the model's score of every whole text, in a column ``name``, with
    trailing underscores where ``keep`` has that name."""
    keep = docs.columns if keep is None else keep
    name = fresh(docs.select(*[F.col(quoted(c)) for c in keep]), name)
    parts = (model.base, model.feature, model.cut, model.leaf)

    def work(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return [pa.array(Trees(*parts).score(statistics(buf, offs)))]

    return map_texts(docs, text, [T.StructField(name, T.DoubleType())], work, keep)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from a score of 0.7)."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = CUT) -> DataFrame:
    """Rows of ``docs``, in its columns, whose score is at least ``least``."""
    name = fresh(docs, "score")
    out = scored(docs, train(docs, labels), name=name)
    return out.where(F.col(name) >= least).drop(name)
