"""Operator 13, source divergence audit: exact sparse document vectors, summed by group, compared in pairs.

1. Documents become sparse vectors (term, count) inside their chunk, exact because terms are compared by their bytes. They are summed
   by (lang, source), like a summarizer's sums: each chunk sums its own documents, Spark combines the partial sums map-side and
   once more after the shuffle. Documents per term are summed along, so one pass and one shuffle serve the next step as well.
2. Count vectorizer per lang: the vocabulary holds the terms that occur in at least ``min_df`` documents of
   the lang, at most ``vocab_size`` of them (by default the largest integer, so none is left out). It is a
   table with dense term numbers, not a list on the driver; the group sums keep its terms by a join.
3. Pairs: blocks of ``TERMS`` term numbers and two tiles of ``TILE`` sources are compared as arrays. Terms
   that neither source has contribute a constant that is added by count, so a block holds only terms
   that occur.

With N the sum of a group's counts and V the size of its lang's vocabulary, a term has
p = 1 + floor(10^9 * (count + 1) / (N + V)), and the divergence of p from q is f = floor((p - q)^2 / q).
Shares are decimals in the JVM, and (p - q)^2 is at most 10^18, so all values are exact.

Defined results: a null text, lang or source counts as ''; an empty text adds a group without terms; groups without
terms have value 0 if V = 0 and take part in all pairs; a source alone in its lang has no pair; repeated
rows count each time; very long texts are read whole; an empty table gives no rows; other columns, whatever
their names, are not read.

Scale: pairs of sources are the result (S^2 per lang); the work is V * S^2 in blocks of bounded size, whose number
grows with both. A hot source is one row per term and task after map-side sums, and the vectors never leave their chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.shared import first_ranked, stored
from chorus.llm.textarrays import chunks_of, lowered, quoted
from chorus.llm.wordchunks import CHUNK_BYTES, Coded, encoded, numbered

# Term characters: letters A-Z (lower-cased) and everything beyond ASCII.
TERM = lowered(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
MIN_DF = 3
VOCAB_SIZE = 2**31 - 1
SCALE = 1_000_000_000
TERMS, TILE = 4096, 32
TOP_TERMS = 200

CELLS = "lang string, source string, word string, count bigint, docs bigint"


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class Vectors:
    """The documents of a chunk as exact sparse vectors over the chunk's own terms: ``doc``, ``code``, ``count`` per cell, in
    the order of the documents, and per document its ``group``, one of ``langs`` and ``sources``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, keys: list[pa.Array]):
        lang, langs = encoded(keys[0])
        source, sources = encoded(keys[1])
        self.terms = Coded(buf, offs, lang, len(langs), TERM)
        width = max(len(self.terms.counts), 1)
        cell, self.count = np.unique(self.terms.text * width + self.terms.codes, return_counts=True)
        self.doc, self.code = cell // width, cell % width
        group, self.group = np.unique(lang * len(sources) + source, return_inverse=True)
        self.langs, self.sources = langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources)))

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, code, sum of counts, documents): the vectors of each group summed up."""
        width = max(len(self.terms.counts), 1)
        cell, inverse, docs = np.unique(self.group[self.doc] * width + self.code, return_inverse=True, return_counts=True)
        return cell // width, cell % width, np.bincount(inverse, self.count, len(cell)).astype(np.int64), docs


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), filled("lang").alias("lang"), filled("source").alias("source"))


def _chunks(batch: pa.RecordBatch, chunk_bytes: int):
    for lo, hi, buf, offs in chunks_of(batch.column(0), chunk_bytes):
        yield Vectors(buf, offs, [batch.column(i).slice(lo, hi - lo) for i in (1, 2)])


def group_sums(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, source, word, count, docs): the document vectors of every group summed up. Chunks sum their own documents, Spark
    combines their sums before and after the shuffle. A group without terms has one row whose word is null."""
    def run(batches):
        for batch in batches:
            for chunk in _chunks(batch, chunk_bytes):
                group, code, count, number = chunk.summed()
                yield pa.RecordBatch.from_arrays([chunk.langs.take(pa.array(group)), chunk.sources.take(pa.array(group)), chunk.terms.spelled.take(pa.array(code)), pa.array(count), pa.array(number)],
                                                 ["lang", "source", "word", "count", "docs"])
                every, zero = len(chunk.langs), np.zeros(len(chunk.langs), np.int64)
                yield pa.RecordBatch.from_arrays([chunk.langs, chunk.sources, pa.nulls(every, pa.string()), pa.array(zero), pa.array(zero)], ["lang", "source", "word", "count", "docs"])

    return _keyed(docs).mapInArrow(run, CELLS).groupBy("lang", "source", "word").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def count_vectorizer(sums: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """The vocabulary, stored: (lang, word, n, docs, id) with dense numbers ``id`` from 1 over all langs. Of a lang with more terms
    than ``vocab_size`` the most frequent are kept, ties by term."""
    kept = sums.where("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_df)
    if vocab_size < VOCAB_SIZE:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        kept = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= vocab_size).drop("place")
    return numbered(kept, "vocabulary")


def document_vectors(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document that has a term of the vocabulary: ``doc_id``, ``lang``, ``source``, ``vector``, an array of (id, count) by
    rising id. For users of the vectors themselves; the audit sums them before terms meet the vocabulary."""
    keyed = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col("text").cast("string").alias("text"), filled("lang").alias("lang"), filled("source").alias("source"))
    held = stored(keyed.withColumn("doc", F.monotonically_increasing_id()), "documents")

    def run(batches):
        for batch in batches:
            at = 0
            for chunk in _chunks(batch, chunk_bytes):
                n = len(chunk.group)
                rows = batch.column(3).slice(at, n).take(pa.array(chunk.doc))
                at += n
                yield pa.RecordBatch.from_arrays([rows, chunk.langs.take(pa.array(chunk.group[chunk.doc])), chunk.terms.spelled.take(pa.array(chunk.code)), pa.array(chunk.count.astype(np.int64))],
                                                 ["doc", "lang", "word", "count"])

    cells = held.select("text", "lang", "source", "doc").mapInArrow(run, "doc bigint, lang string, word string, count bigint")
    known = cells.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("id", "count"))).alias("vector"))
    return held.drop("text").join(known, "doc").select("doc_id", "lang", "source", "vector")


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + size)), exact where the product passes 64 bits; 0 if total + size is 0."""
    up = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    down = total + size
    return F.when(down > 0, 1 + F.call_function("div", up, F.greatest(down, F.lit(1).cast("long")).cast("decimal(19,0)"))).otherwise(F.lit(0).cast("long"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two shares; 0 where the lang has no term."""
    return F.when(q > 0, F.call_function("div", (p - q) * (p - q), F.greatest(q, F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))


def group_facts(groups: DataFrame, sums: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per group: ``total`` (N), ``size`` (V), ``bare`` (share of a term that does not occur), ``number`` of the source in its
    lang from 0, ``tile`` and ``tiles``."""
    own = sums.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    zero = F.lit(0).cast("long")
    known = groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("size", zero).alias("size"))
    per_lang = Window.partitionBy("lang")
    known = known.withColumn("bare", share(zero, F.col("total"), F.col("size"))).withColumn("number", F.row_number().over(per_lang.orderBy("source")) - 1)
    return known.withColumn("tile", F.floor(F.col("number") / TILE)).withColumn("tiles", F.floor(F.max("number").over(per_lang) / TILE) + 1)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: sums of f over its terms for the ordered pairs of its two tiles. Rows without id give each source's bare share."""
    bare = pdf[pdf["id"] < 0].sort_values("number")
    numbers, tile = bare["number"].to_numpy(), bare["tile"].to_numpy()
    cells = pdf[pdf["id"] >= 0]
    terms, column = np.unique(cells["id"].to_numpy(), return_inverse=True)
    p = np.repeat(bare["p"].to_numpy(np.int64)[:, None], len(terms), 1)
    p[np.searchsorted(numbers, cells["number"].to_numpy()), column] = cells["p"].to_numpy(np.int64)
    first, second = pdf["tile_a"].iloc[0], pdf["tile_b"].iloc[0]
    out = []
    for g in range(len(numbers)):
        other = np.flatnonzero((numbers != numbers[g]) if first == second else (tile != tile[g]))
        gap = p[g][None, :] - p[other]
        out.append(pd.DataFrame({"number": numbers[g], "other": numbers[other], "value": (gap * gap // np.maximum(p[other], 1)).sum(1), "seen": len(terms)}))
    made = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["number", "other", "value", "seen"])
    made.insert(0, "lang", pdf["lang"].iloc[0])
    return made.astype({"number": "int64", "other": "int64", "value": "int64", "seen": "int64"})


def pair_values(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, number, other, value): f summed over all terms of the lang, for every ordered pair of its sources.

    ``cells`` has (lang, number, tile, tiles, id, p). A cell goes to the blocks of its tile with each tile."""
    def spread(df: DataFrame, block: Column) -> DataFrame:
        each = df.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return each.select("lang", block.alias("block"), F.least("tile", "with").alias("tile_a"), F.greatest("tile", "with").alias("tile_b"), "number", "tile", "id", "p")

    dealt = spread(cells, F.floor(F.col("id") / TERMS))
    fill = facts.select("lang", "number", "tile", "tiles", F.lit(-1).cast("long").alias("id"), F.col("bare").alias("p"))
    keys = dealt.select("lang", "block", "tile_a", "tile_b").distinct()
    empty = spread(fill, F.lit(-1).cast("long"))          # one block without terms per pair of tiles: every pair appears
    filled_in = empty.drop("block").join(keys, ["lang", "tile_a", "tile_b"])
    every = dealt.unionByName(filled_in).unionByName(empty)
    found = every.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(_block, "lang string, number bigint, other bigint, value bigint, seen bigint")
    return found.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def audit(docs: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: part ``pair`` has every other source of the lang by
    divergence from it, part ``term`` the ``top`` terms that the source uses more than its lang does."""
    every = stored(group_sums(docs), "sums")
    vocabulary = count_vectorizer(every, min_df, vocab_size)
    groups = every.where("word is null").select("lang", "source")
    sums = stored(every.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select("lang", "source", "id", "count"), "counts")
    facts = stored(group_facts(groups, sums, vocabulary), "facts")
    cells = stored(sums.join(facts, ["lang", "source"]).select("lang", "source", "number", "tile", "tiles", "id", share(F.col("count"), F.col("total"), F.col("size")).alias("p")), "cells")

    sides = facts.select("lang", "number", "source", "bare", "size")
    other = facts.select("lang", F.col("number").alias("other"), F.col("source").alias("item"), F.col("bare").alias("q"))
    pairs = pair_values(cells.drop("source"), facts).join(sides, ["lang", "number"]).join(other, ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("size") - F.col("seen")) * divergence(F.col("bare"), F.col("q"))).alias("value"))

    whole = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    terms = vocabulary.join(whole, "lang").select("id", F.col("word").alias("item"), share(F.col("n"), F.col("total"), F.col("size")).alias("q"))
    used = cells.join(terms, "id").where(F.col("p") > F.col("q"))
    used = used.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = first_ranked(used, ["lang", "source", "part"], [F.desc("value"), "item"], top, ["item"], 16)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
