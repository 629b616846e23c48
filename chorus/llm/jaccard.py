"""Operator 10, n-gram Jaccard join with Bayesian candidate pruning.

Words are runs of characters other than white space, A-Z lower-cased; a document's set holds the
64-bit hashes of its runs of five words (a text of one to four words has one shingle of them all).
Two documents are linked if the Jaccard similarity of their sets is at least 0.8.

1. Documents with equal sets form one class, found by a digest of the set. Everything after works
   on one number per class, so exact copies never meet each other in a join, and sets that share a
   doc_id or have none stay apart.
2. Candidates: 160 MinHash values in 32 bands of 5. Two sets of similarity 0.8 miss all bands with a
   chance of 3e-6, sets of 0.9 with 4e-13. Per band value only stars are made: each member points
   to the smallest representative, its hub; a pair that shares a band value shares that hub.
3. Each hub's members meet in blocks of at most ``BLOCK`` x ``BLOCK`` documents, one task group per
   block pair, so no group grows without bound. Inside a block pairs are compared by their MinHash
   values, 32 at a time: with a flat prior the similarity given m matches of n is Beta(m + 1,
   n - m + 1), and a pair is dropped once the posterior chance of reaching 0.8 is below 1e-6.
   Every pair that is left is verified exactly on its full sets.
4. Blocks give back, per representative, the number of linked documents, and for the members that
   verified links connect a star around the smallest (fewer edges than members), never a row per pair. A pair that meets under
   several hubs counts under the smallest only. Components of the stars are the classes; the smallest doc_id of a
   class is found when they are known.

Defined results: null and empty texts have no set; each such row is a class of its own without
links, except that rows with equal doc_id share it. Repeated rows are copies of each other. A null
doc_id takes part with no name of its own: it counts as the largest name when the smallest document of a class
is chosen, and a class of such rows only has a null name. Rows of equal doc_id and different sets are separate documents. An empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm import urlfilter
from chorus.llm.components import connected_components
from chorus.llm.shared import stored
from chorus.llm.textarrays import SPACED, Words, fresh, map_texts, mix64, quoted, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
TOLERANCE = 1e-6
STEP = 32
BLOCK = 256
BROADCAST_IDS = 1 << 21             # 16 MB of ids
BLOOM_BLOCKS = 1 << 21              # 32 MB as a table of blocks and bits


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and masks of the MinHash functions, from a fixed rule."""
    seed = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[n:] >> np.uint64(32)).astype(np.uint32)


def sets_of(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(buf, offs, SPACED)
    hashes, first = words.hashes, words.first
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = hashes[a:b]
        out.append(np.unique(shingle_hashes(own, min(width, len(own)))) if len(own) else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, factor: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """MinHash values of one set; long sets go through in slices of bounded size."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 1024):
        part = (small[at : at + 1024, None] ^ mask) * factor
        np.minimum(low, part.min(axis=0), out=low)
    return low


def cutoffs(total: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed) at every step: fewer matches leave a posterior chance below
    ``tolerance`` that the similarity reaches ``threshold``."""
    out = []
    for n in range(step, total + 1, step):
        need = 0
        while need <= n and beta_above(need + 1, n - need + 1, threshold) < tolerance:
            need += 1
        out.append((n, need))
    return out


def beta_above(a: int, b: int, x: float) -> float:
    """P(Beta(a, b) > x) for whole a and b: at most a - 1 successes in a + b - 1 trials of chance x."""
    n = a + b - 1
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                        + k * math.log(x) + (n - k) * math.log1p(-x)) for k in range(a))


def profiles(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, set_key, n_shingles, bands): digest of the set and its band values."""
    factor, mask = permutations(BANDS * ROWS)
    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("n_shingles", T.IntegerType()),
              T.StructField("bands", T.ArrayType(T.LongType()))]

    def work(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        keys, sizes, bands = [], [], []
        for shingles in sets_of(buf, offs, width):
            sizes.append(len(shingles))
            if not len(shingles):
                keys.append(None)
                bands.append(None)
                continue
            keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            rows = signature(shingles, factor, mask).reshape(BANDS, ROWS).astype(np.uint64)
            value = np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
            bands.append(value.view(np.int64))
        return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]

    return map_texts(docs.select("doc_id", "text"), "text", fields, work, ["doc_id"])


def stars(reps: DataFrame) -> DataFrame:
    """(hub, rep): for each band value with several representatives, the smallest one and each member.

    ``reps`` has (rep, bands). A popular band value is one aggregate and one narrow join; its members
    are never gathered."""
    band = reps.select("rep", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return band.join(shared, "band").select("hub", "rep").distinct()


def block_rows(star: DataFrame, block: int) -> DataFrame:
    """(hub, i, j, side, rep): members of a hub dealt into blocks, one task group per pair of blocks."""
    size = star.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    size = size.where("n > 1").select("hub", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts"))
    dealt = star.join(size, "hub").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.select("hub", "rep", "own", other.alias("other")).select(
        "hub", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("right"))


def verified(left: list, right: list | None, threshold: float, needed: list[tuple[int, int]]):
    """Index pairs of a block whose sets reach the threshold. Rows are (rep, hubs, weight, set, values);
    ``right`` is None for the pairs inside ``left``."""
    other = left if right is None else right
    a = np.stack([r[4] for r in left])
    b = np.stack([r[4] for r in other])
    rows, cols = np.triu_indices(len(left), 1) if right is None else (x.ravel() for x in np.indices((len(left), len(other))))
    same = np.zeros(len(rows), np.int32)
    at = 0
    for n, need in needed:
        same += (a[rows, at:n] == b[cols, at:n]).sum(axis=1, dtype=np.int32)
        stay = same >= need
        rows, cols, same, at = rows[stay], cols[stay], same[stay], n
    if not len(rows):
        return rows, cols
    la = np.array([len(r[3]) for r in left])
    lb = np.array([len(r[3]) for r in other])
    inter = np.zeros(len(rows), np.int64)
    if len(rows) > 64 and len(rows) * 2 > len(np.unique(rows)) * len(np.unique(cols)):
        inter = dense_overlap([r[3] for r in left], [r[3] for r in other])[rows, cols]
    else:
        for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)):
            x, y = left[i][3], other[j][3]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                if len(x) > len(y):
                    x, y = y, x
                spot = np.searchsorted(y, x)
                spot[spot == len(y)] = 0
                inter[k] = int((y[spot] == x).sum())
    union = la[rows] + lb[cols] - inter
    linked = inter >= threshold * union - 1e-9
    return rows[linked], cols[linked]


def dense_overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by slices of a 0/1 matrix product."""
    columns, inverse = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(columns), 2048):
        a, b = np.searchsorted(inverse, [lo, lo + 2048])
        grid = np.zeros((len(left) + len(right), 2048), np.float32)
        grid[owner[a:b], inverse[a:b] - lo] = 1
        out += grid[: len(left)] @ grid[len(left):].T
    return np.rint(out).astype(np.int64)


def forest(reps: list[int], rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Stars that join the same members as all of (rows, cols): each joined member with the smallest
    ``reps`` among those it is joined to, at most one edge per member."""
    root = list(range(len(reps)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            if reps[x] > reps[y]:
                x, y = y, x
            root[y] = x
    return [(c, x) for x in range(len(reps)) if (c := top(x)) != x]


def links_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, other): per block and representative the linked documents; star edges (rep, other).

    ``members`` has (hub, i, j, right, rep, hubs, weight, shingles). Rows of a block arrive sorted; a
    task holds one block at a time."""
    factor, mask = permutations(BANDS * ROWS)
    needed = cutoffs(BANDS * ROWS, STEP, threshold, TOLERANCE)
    keys = ["hub", "i", "j"]
    out = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("other", T.LongType())])

    def emit(key, rows):
        hub, i, j = key
        rows.sort(key=lambda r: r[0])
        left = [r for r in rows if not r[5]]
        right = None if i == j else [r for r in rows if r[5]]
        if not left or right == []:
            return None
        a, b = verified(left, right, threshold, needed)
        other = left if right is None else right
        mine = np.fromiter((next((h for h in left[x][1] if h in other[y][1]), hub) == hub
                            for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = a[mine], b[mine]
        if not len(a):
            return None
        shift = 0 if right is None else len(left)
        every = left if right is None else left + right
        weight = np.array([r[2] for r in every], np.int64)
        count = np.bincount(a, weight[b + shift], len(every)) + np.bincount(b + shift, weight[a], len(every))
        reps = [r[0] for r in every]
        edges = forest(reps, a, b + shift)
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array([reps[x] for x in some.tolist()] + [reps[x] for x, _ in edges], pa.int64()),
             pa.array(count[some].astype(np.int64).tolist() + [None] * len(edges), pa.int64()),
             pa.array([None] * len(some) + [reps[y] for _, y in edges], pa.int64())], ["rep", "links", "other"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            hubs_all, sets_all = batch.column("hubs"), batch.column("shingles")
            keys_now = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            reps, right, weight = (batch.column(c).to_pylist() for c in ("rep", "right", "weight"))
            for k, now in enumerate(keys_now):
                if now != key:
                    if len(rows) > 1 and (block := emit(key, rows)) is not None:
                        yield block
                    key, rows = now, []
                shingles = sets_all[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows.append((reps[k], hubs_all[k].as_py(), weight[k], shingles, signature(shingles, factor, mask), right[k]))
        if len(rows) > 1 and (block := emit(key, rows)) is not None:
            yield block

    wide = members.select(*keys, "right", "rep", "hubs", "weight", "shingles")
    return wide.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_key) of every row, and per distinct set: ``set_key``, ``name`` (its smallest doc_id),
    ``weight`` (rows with it), ``n_links``, ``root`` (number of its class) and ``class_id`` (smallest doc_id of the class).

    A set's number ``rep`` is unique and stored with it; it says nothing about the doc_ids."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = stored(profiles(docs, width), "profiles")
    equal = seen.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("weight"), F.min("bands").alias("bands"))
    equal = stored(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")
    star = stored(stars(equal.select("rep", "bands")), "stars")
    hubs = star.groupBy("rep").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))
    wanted = stored(equal.select("rep", "name", "weight", "set_key").join(hubs, "rep"), "wanted")

    fields = [T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("set_key", T.BinaryType())]

    def again(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        sets = sets_of(buf, offs, width)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        ends = np.cumsum([0, *(len(x) for x in sets)]).astype(np.int32)
        keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(keys, pa.binary())]

    # one row of each wanted set: by its smallest doc_id, or from the rows without one
    texts = by_ids(docs, wanted.select(F.col("name").alias("doc_id")).distinct(), inside=True)
    if not equal.where("name is null").isEmpty():
        texts = texts.unionByName(docs.where("doc_id is null"))
    read = map_texts(texts, "text", fields, again, [])
    sets = read.where("set_key is not null").dropDuplicates(["set_key"]).join(wanted.drop("name"), "set_key").drop("set_key")
    members = block_rows(star, block).join(sets, "rep")
    found = stored(links_in_blocks(members, threshold), "links")
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select("rep", "other"), "rep", "other")
    groups = (equal.select("set_key", "rep", "name", "weight").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
              .select("set_key", "name", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("component"), F.coalesce("component", "rep").alias("root")))
    groups = stored(groups, "groups")
    names = groups.where("component is not null").groupBy("component").agg(F.min("name").alias("smallest"))
    return seen.select("doc_id", "set_key"), groups.join(names, "component", "left").select(
        "set_key", "name", "weight", "n_links", "root", F.when(F.col("component").isNull(), F.col("name")).otherwise(F.col("smallest")).alias("class_id"))


def named(seen: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``join`` from ``classes``."""
    return (seen.join(groups.withColumn("known", F.lit(True)), "set_key", "left")
            .select("doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.when(F.col("known"), F.col("name")).otherwise(F.col("doc_id")).alias("copy_id"),
                    F.coalesce("weight", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest doc_id of all documents that links
    connect), ``copy_id`` (smallest doc_id with an equal set), ``n_copies`` (documents with an equal
    set, itself included) and ``n_links`` (other documents of similarity at least ``threshold``,
    copies included)."""
    return named(*classes(docs, threshold, width, block))


def by_ids(docs: DataFrame, ids: DataFrame, inside: bool, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``inside``) or is not among the stored, distinct ``ids``; most texts do not move.

    At most ``most`` ids are broadcast. More go into a Bloom filter of a bounded number of bits: rows that miss it are not among
    them for certain, the rows that hit it meet the exact ids in a shuffled join. A null doc_id is never among them."""
    number, own, block, bits = (fresh(docs, c) for c in ("doc_number", "listed_id", "bloom_block", "bloom_bits"))
    ids = ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(own))
    n, given, how = ids.count(), [quoted(c) for c in docs.columns], "left_semi" if inside else "left_anti"
    keyed = docs.withColumn(number, F.col("doc_id").cast("long"))
    if n <= most:
        return keyed.join(F.broadcast(ids), F.col(number) == F.col(own), how).select(*given)
    blocks = min(BLOOM_BLOCKS, n * urlfilter.BITS_PER_KEY // 64 + 1)
    key = F.col(number).cast("string")
    table = urlfilter.bloom_filter(ids.select(F.col(own).cast("string").alias("key")), "key", blocks).select(F.col("bloom_block").alias(block), F.col("bloom_bits").alias(bits))
    met = keyed.withColumn(block, urlfilter.bloom_block(key, blocks)).join(F.broadcast(table), block, "left")        # at most BLOOM_BLOCKS rows
    hit = F.coalesce(F.col(bits).bitwiseAND(urlfilter.bloom_bits(key)) == urlfilter.bloom_bits(key), F.lit(False))
    sure = met.where(hit).join(ids, F.col(number) == F.col(own), how).select(*given)
    return sure if inside else met.where(~hit).select(*given).unionByName(sure)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents in their own columns, one per class: the one whose doc_id names it.

    Rows of equal doc_id and different sets are judged apart: each set belongs to its own class, and of a class one row
    of the set with the smallest doc_id stays, also where no row has a doc_id. Of rows without a set one per
    doc_id stays, and all that have no doc_id either."""
    seen, groups = classes(docs, threshold)
    shared = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if shared.isEmpty():
        return by_ids(docs, stored(named(seen, groups).where("doc_id <> class_id").select("doc_id"), "gone"), inside=False)
    key, own = fresh(docs, "set_key"), fresh(docs, "own_id")

    def keys(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets_of(buf, offs, SHINGLE)], pa.binary())]

    number = F.col("doc_id").cast("long")
    keyed = map_texts(docs, "text", [T.StructField(key, T.BinaryType())], keys).withColumn(own, F.when(F.col(key).isNull(), number))
    text = F.col("text").cast("string")
    rest = F.to_json(F.struct(*[quoted(c) for c in docs.columns if c != "text"]))
    order = F.struct(number.isNull(), number, F.length(text), text, rest)
    kept = (keyed.where(F.col(key).isNotNull() | F.col(own).isNotNull()).groupBy(key, own)
            .agg(F.min_by(F.struct(*[quoted(c) for c in docs.columns]), order).alias("row")))
    first = groups.groupBy("root").agg(F.min_by("set_key", F.struct(F.col("name").isNull(), "name", "set_key")).alias(key)).select(key)
    whole = kept.where(F.col(key).isNotNull()).join(first, key, "left_semi").unionByName(kept.where(F.col(key).isNull()))
    bare = keyed.where(F.col(key).isNull() & F.col(own).isNull()).select(*[quoted(c) for c in docs.columns])
    return whole.select("row.*").unionByName(bare)
