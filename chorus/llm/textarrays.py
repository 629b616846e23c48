"""Words of whole texts as numpy arrays, straight from the UTF-8 buffers of Arrow batches.

A batch is cut into chunks of whole texts of about ``CHUNK_BYTES`` so that memory stays bounded by
the batch that Spark sends plus one chunk (or one text, where a single text is longer). Word
boundaries, lower-casing of A-Z and 64-bit word hashes are array operations over the bytes; no text
is decoded and none is cut short. Two different words share a 64-bit hash with a chance of about
5e-20 per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(word_byte: Callable[[int], bool]) -> np.ndarray:
    """256 entries: the byte with A-Z lower-cased where it belongs to a word, else 0."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 256):
        low = b + 32 if 65 <= b <= 90 else b
        out[b] = low if word_byte(low) else 0
    return out


# Word classes. A NUL byte would be a word character of the first class; it is kept as byte 1.
SPACED = lowered(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SPACED[0] = 1
ALNUM = lowered(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64 and their inverses, grown on demand."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = np.uint64(0xD1342543DE82EF95)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        for key, f in (("up", base), ("down", inverse)):
            steps = np.full(size, f, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Words:
    """Words of the texts of one chunk: byte ranges, hashes and the first word of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.buf, self.offs = buf, offs
        low = table[buf]
        self.low = low
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = offs[1:] > offs[:-1]
            heads, tails = offs[:-1][filled], offs[1:][filled] - 1
            first[heads] = inside[heads]
            last[tails] = inside[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offs)          # per text, one more than texts
        self.counts = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            up, down = _power_tables(len(self.buf) + 1)
            total = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[self.low] * up[: len(self.buf)], out=total[1:])
            self._hashes = mix64((total[self.ends] - total[self.starts]) * down[self.starts])
        return self._hashes

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        total += words[j : j + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64))
    return mix64(total)


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def chunks_of(array: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``size`` bytes."""
    buf, offs = string_buffers(array)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, upper and lower case taken as equal."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(df: DataFrame, text: str, fields: list[T.StructField],
              work: Callable[[np.ndarray, np.ndarray], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with new columns computed from the bytes of the text column.

    ``work`` gets the bytes and offsets of a chunk of whole texts and returns one Arrow array per
    field of ``fields``. The columns ``keep`` (all by default) travel along. New columns are
    appended under the names in ``fields``, which must not occur in ``keep`` (see ``fresh``).
    """
    keep = df.columns if keep is None else keep
    own = fresh(df, "text_in")
    wide = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).cast("string").alias(own))
    schema = T.StructType([f for f in wide.schema.fields[:-1]] + fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi, buf, offs in chunks_of(texts):
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(kept + work(buf, offs), names)

    return wide.mapInArrow(run, schema)
