"""Texts as chunks of word codes with a vocabulary of their own, and one numbering for all chunks.

A chunk holds whole texts of about ``CHUNK_BYTES`` bytes. Its words are numbered inside the chunk by
Arrow's dictionary encoding, which compares bytes, so no two words share a code. The chunk's vocabulary
(lang, word, occurrences, documents) is a column of the chunk's row. The vocabularies of all chunks are
summed up, the words that pass a threshold get dense numbers from 1, and each chunk gets the numbers of its own
words by a join on the word and a second one on the chunk. So a word crosses the network once
per chunk, texts never do, and no task or driver holds the vocabulary of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.shared import stored
from chorus.llm.textarrays import Words, chunks_of

CHUNK_BYTES = 4 << 20
VOCABULARY = "vocabulary array<struct<lang:string,word:string,n:bigint,docs:bigint>>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Coded:
    """Words of a chunk as codes, the most frequent first: ``codes`` per word, and per code ``langs``, ``spelled`` and ``counts``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, text_lang: np.ndarray, n_langs: int, table: np.ndarray):
        self.words = Words(buf, offs, table)
        starts, ends = self.words.starts, self.words.ends
        self.text = self.words.text_of_word()
        spots = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=spots[1:])
        data = _LOWER[buf[self.words.low != 0]]
        every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(spots), pa.py_buffer(data)).dictionary_encode()
        pair = every.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_langs + text_lang[self.text]
        room = len(every.dictionary) * n_langs
        if room <= 8 * len(pair):
            count = np.bincount(pair, minlength=room)
            seen = np.flatnonzero(count)
            seen = seen[np.argsort(-count[seen], kind="stable")]
            number = np.zeros(room, np.int32)
            number[seen] = np.arange(len(seen))
            self.codes, self.counts = number[pair], count[seen]
        else:
            seen, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            number = np.zeros(len(seen), np.int32)
            number[order] = np.arange(len(seen))
            seen, self.codes, self.counts = seen[order], number[inverse], counts[order]
        self.langs = seen % n_langs
        self.spelled = every.dictionary.take(pa.array(seen // n_langs)).cast(pa.string())

    def vocabulary(self, names: pa.Array, docs: np.ndarray) -> pa.Array:
        """The chunk's vocabulary as one list value; ``names`` are the langs, ``docs`` the documents per code."""
        rows = pa.StructArray.from_arrays([names.take(pa.array(self.langs)), self.spelled, pa.array(self.counts.astype(np.int64)), pa.array(docs.astype(np.int64))],
                                          ["lang", "word", "n", "docs"])
        return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def planes(codes: np.ndarray) -> bytes:
    """Codes byte by byte, all lowest bytes first: small codes leave long runs of zeros, which compress."""
    return codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def encoded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code per row, distinct values) of a string column without nulls."""
    column = column.dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary.cast(pa.string())


def chunked(df: DataFrame, text: Column, keys: list[Column], fields: str, work: Callable[[np.ndarray, np.ndarray, list[pa.Array]], list[pa.Array]],
            chunk_bytes: int | None = None) -> DataFrame:
    """Stored rows, one per chunk: ``chunk`` (a number) and the columns ``fields`` that ``work`` makes
    of the chunk's bytes, offsets and key columns. Null texts count as empty; keys must not be null."""
    own = df.select(text.cast("string").alias("text"), *[k.alias(f"key_{i}") for i, k in enumerate(keys)])
    size = chunk_bytes or CHUNK_BYTES
    names, width = [f.split()[0] for f in fields.split(", ")], len(keys)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in chunks_of(batch.column(0), size):
                made = work(buf, offs, [batch.column(1 + i).slice(lo, hi - lo) for i in range(width)])
                yield pa.RecordBatch.from_arrays(made, names)

    return stored(own.mapInArrow(run, fields).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def totals(chunks: DataFrame) -> DataFrame:
    """(lang, word, n, docs): the vocabularies of all chunks summed up."""
    each = chunks.select(F.inline("vocabulary"))
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(words: DataFrame, name: str) -> DataFrame:
    """``words``, stored, with dense numbers ``id`` from 1. No task numbers more than its own rows: each
    partition starts at the number of rows in the partitions before it."""
    held = stored(words.withColumn("spot", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("spot", 33), F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    # one row per partition of the table
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    known = held.withColumn("part", part).join(F.broadcast(before), "part").withColumn("id", inside + F.col("before") + 1)
    return stored(known.drop("part", "spot", "before"), f"{name}_ids")


def with_ids(chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``chunks`` without the vocabulary, with ``known`` (codes that have a number) and ``ids`` (their numbers).

    Chunks without any known word do not appear. A chunk's list is bounded by the chunk."""
    spread = chunks.select("chunk", F.posexplode("vocabulary").alias("code", "entry")).select("chunk", "code", "entry.lang", "entry.word")
    found = spread.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("pairs"))
    found = found.select("chunk", F.col("pairs.code").alias("known"), F.col("pairs.id").alias("ids"))
    return chunks.drop("vocabulary").join(found, "chunk")


def lookup(known: pa.Array, ids: pa.Array, row: int, size: int) -> np.ndarray:
    """Number per code of one chunk, 0 where the code has none."""
    out = np.zeros(size, np.int64)
    out[known[row].values.to_numpy(zero_copy_only=False)] = ids[row].values.to_numpy(zero_copy_only=False)
    return out
