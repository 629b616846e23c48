"""Operator 6, URL filters: a blocked Bloom filter before an exact hash join, in DataFrame operations.

A list holds keys ``host/path``; an entry fits a URL if its host is the URL's host or a parent domain
of it and the URL's path starts with the entry's path. The longest fitting entry decides.

1. Each distinct URL offers as candidates its host suffixes combined with the prefixes of its path
   that have the length of some listed path (the lengths are a handful of numbers).
2. The blocked Bloom filter of the listed keys drops almost every candidate: a key's hash picks one
   64-bit block and ``PROBES`` bits in it. The filter is a table (block, bits), joined on the block.
3. An exact join on host and path removes the false positives of what is left.

The filter and the list are broadcast only where their measured size is at most ``BROADCAST_BYTES``;
beyond it both joins are shuffled on their keys.

URLs: the host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
follows up to ``?``, ``#`` or the end. Defined results: a null URL or one without ``://`` has an empty
host and path, fits nothing and is allowed; an empty list allows everything; repeated rows are
judged alike; of equal entries listed twice with different verdicts, block wins; very long URLs are
read whole; extra columns of the pages stay out of the result of ``judged`` and travel along in
``screened``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.textarrays import fresh, quoted

PROBES = 5
BITS_PER_KEY = 16
BROADCAST_BYTES = 32 << 20

# Fixed rules of the query: (verdict, host, path); the longest that fits decides.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# The query's block list, in canonical form: host and path of each listed site.
LISTED = [(f"{name}.example.{zone}", "/") for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
          for zone in ("com", "net", "org")]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, both empty for null or without ``://``."""
    url = url.cast("string")
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring_index(url.substr(F.instr(url, "://") + 3, F.length(url)), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return (F.when(has, lowered(host)).otherwise(""), F.when(has, rest.substr(F.length(host) + 1, F.length(rest) + 1)).otherwise(""))


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """The host and path under which a site is listed and looked up: without user, port and the host's closing dots; a missing
    path is ``/``."""
    bare = F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", ""), r"\.+$", "")
    return bare, F.when(path == "", "/").otherwise(path)


def list_of(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) entries as a table, built from literals."""
    if not entries:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in ("verdict", "host", "path")])
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in entries]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def bloom_bits(key: Column) -> Column:
    """The bits of a key inside its block: ``PROBES`` positions from slices of a second hash."""
    h = F.xxhash64(key, F.lit(61))
    bits = F.lit(0).cast("long")
    for i in range(PROBES):
        position = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return bits


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(60)), F.lit(blocks))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits): the blocked Bloom filter of a key column."""
    return keys.groupBy(bloom_block(F.col(key), blocks).alias("bloom_block")).agg(F.bit_or(bloom_bits(F.col(key))).alias("bloom_bits"))


def longest_fits(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path, rule, verdict): for distinct (host, path) pairs, the longest fitting entry; pairs
    without one do not appear.

    A candidate is a host suffix at a label border and a path prefix of a listed length."""
    entries = entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))      # block sorts after allow
    shape = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path") + 64), F.lit(0)).alias("bytes"),
                        F.collect_set(F.length("path")).alias("lengths")).first()
    if not shape.n:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).where(F.lit(False))
    blocks = max(1, shape.n * BITS_PER_KEY // 64)
    small = F.broadcast if max(shape.bytes, blocks * 16) <= BROADCAST_BYTES else (lambda df: df)
    listed = entries.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), "verdict",
                            F.concat("host", F.lit(" "), "path").alias("key"))
    filter_ = bloom_filter(listed, "key", blocks)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    reach = F.length("path")
    lengths = F.array(*[F.lit(int(n)) for n in sorted(shape.lengths)])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= reach), lambda n: F.col("path").substr(F.lit(1), n))
    offered = urls.where("host <> ''").select("host", "path", F.explode(suffixes).alias("c_host"), prefixes.alias("prefixes"))
    offered = offered.select("host", "path", "c_host", F.explode("prefixes").alias("c_path"))
    offered = offered.withColumn("key", F.concat("c_host", F.lit(" "), "c_path"))
    possible = (offered.withColumn("bloom_block", bloom_block(F.col("key"), blocks)).join(small(filter_), "bloom_block")
                .where(F.col("bloom_bits").bitwiseAND(bloom_bits(F.col("key"))) == bloom_bits(F.col("key"))).drop("bloom_block", "bloom_bits"))
    exact = possible.join(small(listed), "key")
    rule = F.concat("e_host", "e_path")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("verdict"))).alias("best")
    return exact.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def fitted(df: DataFrame, entries: DataFrame, host: str, path: str, names: tuple[str, str]) -> DataFrame:
    """``df`` with rule and verdict of the longest entry that fits its host and path columns, under ``names``."""
    urls = df.select(F.col(quoted(host)).alias("host"), F.col(quoted(path)).alias("path")).distinct()
    fits = longest_fits(urls, entries).select(*[F.col(c).alias(f"fit_{c}") for c in ("host", "path", "rule", "verdict")])
    out = df.join(fits, (F.col(quoted(host)) == F.col("fit_host")) & (F.col(quoted(path)) == F.col("fit_path")), "left")
    return out.select(*[F.col(quoted(c)) for c in df.columns], F.col("fit_rule").alias(names[0]), F.col("fit_verdict").alias(names[1]))


def screened(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (null where no entry fits); a name that
    clashes gets a trailing underscore."""
    names = [fresh(pages, n) for n in ("host", "path", "rule", "verdict")]
    host, path = parts_of(F.col(quoted(url)))
    return fitted(pages.withColumn(names[0], host).withColumn(names[1], path), entries, names[0], names[1], (names[2], names[3]))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, listed: list[tuple[str, str]] = LISTED) -> DataFrame:
    """Per page: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``: the longest rule's, else block for
    a listed site, else allow. Rules meet the URL as it is written; the list, which is in canonical form, meets its canonical form.
    Each goes through a filter of its own, and a rule always comes before a listed site."""
    spark = pages.sparkSession
    by_rule = screened(pages.select("page_id", F.col("url").cast("string")), list_of(spark, rules))
    host, path = canonical(F.col("host"), F.col("path"))
    sites = by_rule.withColumn("site_host", host).withColumn("site_path", path)
    by_list = fitted(sites, list_of(spark, [("block", h, p) for h, p in listed]), "site_host", "site_path", ("site_rule", "site_verdict"))
    return by_list.select("page_id", "host", "path", "rule", F.coalesce("verdict", "site_verdict", F.lit("allow")).alias("verdict"))
