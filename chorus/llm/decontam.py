"""Operator 9, benchmark decontamination: a generalised suffix automaton of the test items.

Items and documents are cut into words (A-Z lower-cased; words are runs of letters, digits and
characters beyond ASCII). A window is ``width`` consecutive words of an item; an item with fewer
words, but not none, is one window. The automaton of all items reads each document word by word and
keeps the length of the longest item passage that ends there; where that length reaches a window,
the window's words are hit.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; items with equal texts all count, rows that repeat an item_id count once; an empty item table leaves every document clean; repeated
documents are judged one by one; very long texts are read whole; extra columns travel along, and new
columns whose names clash get a trailing underscore from ``scan``.

Scale: documents are never shuffled, and read once per pass. Items are taken in blocks of about
``block_bytes`` of text (usually one); rows that repeat an item go first, then executors build each block's automaton,
packed into sorted arrays, into a table in the shared folder. A pass loads at most ``MACHINES`` of them from there and
broadcasts them, so what the driver and a task hold is bounded whatever the number of items. A
document's hits are united over the blocks inside its task, and over passes by array expressions on
the spans; between passes the documents go through the shared folder. Before the automaton runs, array
operations discard runs of words whose neighbouring pairs occur in no item: no window can lie across
such a pair, and the longest match at a word inside a run cannot begin before it, so lengths stay exact.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.shared import stored
from chorus.llm.textarrays import ALNUM, Words, fresh, map_texts, quoted

WINDOW = 10
BLOCK_BYTES = 1 << 20
MACHINES = 16                       # automata that a task holds at once


class Automaton:
    """Suffix automaton of several word sequences, with what is needed to name the items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        self.width = width
        words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(words)
        size = max(1, len(self.vocabulary))
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs: list[np.ndarray] = []
        ends: list[tuple[int, int, list[int]]] = []
        self.names = [name for name, _ in items]
        for number, (_, w) in enumerate(items):
            ids = np.searchsorted(self.vocabulary, w)
            pairs.append(ids[:-1] * size + ids[1:])
            ends.append((number, len(ids), self._add(ids.tolist())))
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        lengths = [n for _, n, _ in ends if n]
        self.shortest = min([width, *lengths]) if lengths else 0
        self._name_windows(ends)
        self._pack(size)

    @classmethod
    def of(cls, state: dict) -> Automaton:
        """An automaton from the plain state that was broadcast."""
        machine = cls.__new__(cls)
        machine.__dict__ = state
        return machine

    def _add(self, ids: list[int]) -> list[int]:
        """Extend with one item; the state reached after each of its words."""
        step, link, length = self.step, self.link, self.length
        last, reached = 0, []
        for c in ids:
            if c in step[last] and length[step[last][c]] == length[last] + 1:
                last = step[last][c]
                reached.append(last)
                continue
            if c in step[last]:
                last = self._split(last, c)
                reached.append(last)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c)
            last = new
            reached.append(last)
        return reached

    def _split(self, p: int, c: int) -> int:
        """Copy the target of (p, c) so that its longest string is one word longer than p's."""
        step, link, length = self.step, self.link, self.length
        q, copy = step[p][c], len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def _name_windows(self, ends: list[tuple[int, int, list[int]]]) -> None:
        """For each state: the state of its last ``width`` words; items that hold those words."""
        width, link, length = self.width, self.link, self.length
        order = sorted(range(1, len(link)), key=length.__getitem__)
        self.window = [-1] * len(link)
        for v in order:
            if length[v] >= width:
                self.window[v] = v if length[link[v]] < width else self.window[link[v]]
        self.held: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for number, n, reached in ends:
            if 0 < n < width:
                short.setdefault(reached[-1], []).append((n, number))
            for v in reached[width - 1 :]:
                self.held.setdefault(self.window[v], set()).add(number)
        # whole items shorter than a window that end a state's strings, its own and shorter ones
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in order:
            above = self.short.get(link[v], [])
            if v in short or above:
                self.short[v] = sorted(above + short.get(v, []))

    def _pack(self, size: int) -> None:
        """Replace the tables of the construction by flat arrays: transitions as sorted keys
        ``state * size + word`` with their targets, items of windows as one array with offsets."""
        key = np.array([v * size + c for v, to in enumerate(self.step) for c in to], np.int64)
        to = np.array([t for row in self.step for t in row.values()], np.int64)
        order = np.argsort(key)
        self.size, self.keys, self.targets = size, array("q", key[order].tobytes()), array("q", to[order].tobytes())
        self.link, self.length, self.window = array("q", self.link), array("q", self.length), array("q", self.window)
        states = sorted(self.held)
        self.held_states = array("q", states)
        self.held_ends = array("q", np.cumsum([0, *(len(self.held[v]) for v in states)]).tolist())
        self.held_items = array("q", [k for v in states for k in sorted(self.held[v])])
        del self.step, self.held

    def _items_of(self, window: int) -> frozenset[int]:
        at = bisect_left(self.held_states, window)
        return frozenset(self.held_items[self.held_ends[at] : self.held_ends[at + 1]])

    def hits(self, words: Words) -> list[tuple[int, int, frozenset[int]]]:
        """(first word, end word, items) of window occurrences in the texts of a chunk."""
        if not self.shortest or not len(words.starts):
            return []
        vocabulary = self.vocabulary
        ids = np.searchsorted(vocabulary, words.hashes)
        ids[ids == len(vocabulary)] = 0
        known = vocabulary[ids] == words.hashes
        linked = known[:-1] & known[1:]
        cuts = words.first[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(ids))]
        linked[cuts - 1] = False
        at = np.flatnonzero(linked)
        if len(self.pairs):
            codes = ids[at] * len(vocabulary) + ids[at + 1]
            near = np.searchsorted(self.pairs, codes)
            near[near == len(self.pairs)] = 0
            linked[at[self.pairs[near] != codes]] = False
        else:
            linked[:] = False
        edge = np.diff(np.concatenate(([0], linked.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.shortest == 1:
            lone = known.copy()
            lone[:-1] &= ~linked
            lone[1:] &= ~linked
            begin = np.concatenate((begin, np.flatnonzero(lone)))
            end = np.concatenate((end, np.flatnonzero(lone) + 1))
        enough = end - begin >= self.shortest
        found: list[tuple[int, int, frozenset[int]]] = []
        for a, b in zip(begin[enough].tolist(), end[enough].tolist(), strict=True):
            self._read(ids[a:b].tolist(), a, found)
        return found

    def _read(self, ids: list[int], first: int, found: list) -> None:
        keys, targets, size, link, length, width = self.keys, self.targets, self.size, self.link, self.length, self.width
        state, matched, n_keys = 0, 0, len(keys)
        for i, c in enumerate(ids, first + 1):
            at = bisect_left(keys, state * size + c)
            while state and (at == n_keys or keys[at] != state * size + c):
                state = link[state]
                matched = length[state]
                at = bisect_left(keys, state * size + c)
            if at < n_keys and keys[at] == state * size + c:
                state = targets[at]
                matched += 1
            if matched >= width:
                found.append((i - width, i, self._items_of(self.window[state])))
            if state in self.short:
                whole = [(n, k) for n, k in self.short[state] if n <= matched]
                for n, k in whole:
                    found.append((i - n, i, frozenset((k,))))


def _item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM).hashes


class Machines:
    """Automata of all items, stored by ``block``; iterating gives, pass by pass, at most ``each`` of them as broadcasts."""

    def __init__(self, table: DataFrame | None, blocks: int, each: int):
        self.table, self.blocks, self.each = table, blocks, each

    def __len__(self) -> int:
        return max(1, -(-self.blocks // self.each))

    def __iter__(self) -> Iterator[list[Broadcast]]:
        for first in range(0, max(1, self.blocks), self.each):
            own = [] if self.table is None else self.table.where(F.col("block").between(first, first + self.each - 1)).orderBy("block").collect()
            yield [self.table.sparkSession.sparkContext.broadcast(pickle.loads(r.state)) for r in own]


def passes(items: DataFrame, item_id: str, text: str, width: int, block_bytes: int = BLOCK_BYTES, machines: int = MACHINES) -> Machines:
    """Automata of the items, one per block of about ``block_bytes`` of text, at most ``machines`` for each pass
    over the documents. Blocks are drawn from a hash of the item; tasks build them, one block at a time."""
    row = items.select(F.col(quoted(item_id)).cast("string").alias("name"), F.col(quoted(text)).cast("string").alias("words"))
    row = stored(row.where("words is not null").distinct(), "items")
    total = row.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    if not blocks:
        return Machines(None, 0, machines)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        held = sorted(zip(part["name"], part["words"], strict=True), key=lambda r: (r[0] or "", r[1]))
        machine = Automaton([(name, w) for name, t in held if len(w := _item_words(t))], width)
        return pd.DataFrame({"block": [key[0]], "state": [pickle.dumps(vars(machine), protocol=5)]})

    dealt = row.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks)))
    return Machines(stored(dealt.groupBy("block").applyInPandas(build, "block long, state binary"), "automata"), blocks, machines)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", SPANS)]


def _finder(sent: list[Broadcast]) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
    """What one pass finds in the texts of a chunk: the columns of ``FOUND``."""
    arrow_span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def work(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        words = Words(buf, offs, ALNUM)
        n = len(offs) - 1
        delta = np.zeros(len(words.starts) + 1, np.int64)
        names: list[set[str]] = [set() for _ in range(n)]
        for machine in (Automaton.of(s.value) for s in sent):
            hits = machine.hits(words)
            texts = np.searchsorted(words.first, [h[0] for h in hits], side="right") - 1
            for (a, b, items_hit), t in zip(hits, texts.tolist(), strict=True):
                delta[a] += 1
                delta[b] -= 1
                names[t].update(machine.names[k] for k in items_hit)
        hit = np.cumsum(delta[:-1]) > 0
        n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), words.first[:-1]) if n else np.zeros(0, np.int64)
        n_hit[words.counts == 0] = 0
        spans: list[list[dict]] = [[] for _ in range(n)]
        for t in np.flatnonzero(n_hit).tolist():
            own = hit[words.first[t] : words.first[t + 1]]
            edge = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
            spans[t] = [{"first": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        return [pa.array(words.counts.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
                pa.array([sorted(y for y in x if y is not None) for x in names], pa.list_(pa.string())), pa.array(spans, arrow_span)]

    return work


def _united(spans: Column) -> Column:
    """Overlapping and touching spans as one."""
    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (last["end"] >= s["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def found_in(docs: DataFrame, text: str, sent: Machines, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns ``keep`` of ``docs`` with those of ``FOUND``, and the names that these got."""
    shape = docs.select(*[F.col(quoted(c)) for c in keep])
    names = [fresh(shape, n) for n, _ in FOUND]
    more = [fresh(shape, f"more_{n}") for n, _ in FOUND]
    body = fresh(shape, "scanned_text")
    now = docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).cast("string").alias(body))
    for k, machines in enumerate(sent):
        travels = keep + (names if k else []) + ([body] if k + 1 < len(sent) else [])
        fields = [T.StructField(n, t) for n, (_, t) in zip(more if k else names, FOUND, strict=True)]
        now = map_texts(now, body, fields, _finder(machines), travels)
        if k:
            _, _, n_items, held, spans = ((F.col(quoted(a)), F.col(quoted(b))) for a, b in zip(names, more, strict=True))
            nameless = F.greatest(*[n - F.size(i) for n, i in zip(n_items, held, strict=True)])
            now = now.withColumns({names[3]: F.array_sort(F.array_union(*held)), names[4]: _united(F.concat(*spans)), names[2]: F.size(F.array_union(*held)) + nameless})
            now = now.withColumn(names[1], F.aggregate(F.col(quoted(names[4])), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])).drop(*more)
            now = now.withColumn(names[2], F.col(quoted(names[2])).cast("long"))
        if k + 1 < len(sent):
            now = stored(now, "pass")
    return now.select(*[F.col(quoted(c)) for c in keep + names]), names


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, machines: int = MACHINES) -> DataFrame:
    """Documents with their hits: ``n_words``, ``n_hit``, ``n_items``, ``items`` (names, sorted as
    strings) and ``spans`` (first and end word of each united hit passage)."""
    sent = passes(items, item_id, item_text, width, block_bytes, machines)
    return found_in(docs, text, sent, docs.columns if keep is None else keep)[0]


def without_passages(docs: DataFrame, text: str, sent: Machines) -> DataFrame:
    """``docs`` with all hit passages cut out of the text (see ``cut_text``); with several passes, the
    cycle of passes is repeated until no text has a hit, as a cut can make a window of another pass."""
    clean = fresh(docs, "clean")

    def cutter(machines: list[Broadcast]):
        def work(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            held = [Automaton.of(s.value) for s in machines]
            return [pa.array([cut_text(bytes(buf[a:b]), held) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string())]
        return work

    while True:
        for machines in sent:
            done = map_texts(docs, text, [T.StructField(clean, T.StringType())], cutter(machines))
            done = done.select(*[F.col(quoted(clean)).alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
            docs = done if len(sent) == 1 else stored(done, "cut")
        if len(sent) == 1:
            return docs
        seen, names = found_in(docs.select(F.col(quoted(text)).alias("body")), "body", sent, [])
        if seen.where(F.col(names[1]) > 0).isEmpty():
            return docs


def cut_text(raw: bytes, machines: list[Automaton]) -> str:
    """The text without its hit words, each removed passage leaving one line break; repeated until
    nothing is hit, as a cut can bring two halves of a window together."""
    while True:
        data = np.frombuffer(raw, np.uint8)
        words = Words(data, np.array([0, len(data)]), ALNUM)
        hit = np.zeros(len(words.starts) + 1, np.int64)
        for m in machines:
            for a, b, _ in m.hits(words):
                hit[a] += 1
                hit[b] -= 1
        inside = np.cumsum(hit[:-1]) > 0
        if not inside.any():
            return raw.decode("utf-8", "replace")
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        out, at = [], 0
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            out += [raw[at : words.starts[a]], b"\n"]
            at = int(words.ends[b - 1])
        raw = b"".join([*out, raw[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW,
                  max_words: int = 0, max_coverage: float = 0.0, block_bytes: int = BLOCK_BYTES, machines: int = MACHINES) -> DataFrame:
    """Documents without leaked passages, in the columns of ``docs``.

    A document stays whole if it has no hit. With hits, it goes if its longest passage has more than
    ``max_words`` words or its hit words are more than ``max_coverage`` of its words (by default any
    hit removes it); otherwise its passages are cut out of the text."""
    sent = passes(items, item_id, item_text, width, block_bytes, machines)
    seen, names = found_in(docs, text, sent, docs.columns)
    n_words, n_hit, spans = (F.col(quoted(names[i])) for i in (0, 1, 4))
    if not (max_words > 0 and max_coverage > 0):
        return seen.where(n_hit == 0).drop(*names)
    longest = F.array_max(F.transform(spans, lambda s: s["end"] - s["first"]))
    stays = stored(seen.where((n_hit == 0) | ((longest <= max_words) & (n_hit <= n_words * F.lit(max_coverage)))).drop(*[n for n in names if n != names[1]]), "stays")
    whole, leaked = stays.where(n_hit == 0).drop(names[1]), stays.where(n_hit > 0).drop(names[1])
    return whole.withColumn(text, F.col(quoted(text)).cast("string")).unionByName(without_passages(leaked, text, sent))


def digest(names: Column) -> Column:
    return F.sha2(F.concat_ws(",", names), 256)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    seen = scan(docs.select("doc_id", "text"), items, width=width, keep=["doc_id"])
    return seen.select("doc_id", "n_words", "n_hit", "n_items", digest(F.col("items")).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"), "spans")

