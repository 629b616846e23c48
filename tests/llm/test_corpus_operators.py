"""Corpus operators against brute force on small hand-made tables: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import components, decontam, html, jaccard, licenses, mixing, quality, rules, shards, shared, urlfilter, warc
from chorus.llm.textarrays import ALNUM, SPACED, Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts, sources=None):
    return [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)]


def random_texts(n, seed=5, vocab=40, longest=60):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6))) for _ in range(vocab)]
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, longest))) for _ in range(n)]


# words -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("table,pattern", [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_match_the_pattern(table, pattern):
    texts = ["", " a  b\tc\n", "Ab-cD éÀ 12", "x", "  ", "tail\x0b\x0cend ", "\u00a0\u2003 z", "A" * 300]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *(len(r) for r in raw)])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offs, table)
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, t in enumerate(texts):
        want = re.findall(pattern, t.translate(upper))
        got = [bytes(w.low[a:b]).decode() for a, b in zip(w.starts[w.first[k]:w.first[k + 1]], w.ends[w.first[k]:w.first[k + 1]], strict=True)]
        assert got == want
    by_word = {}
    for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends, strict=True):
        assert by_word.setdefault(bytes(w.low[a:b]), h) == h
    assert len(set(by_word.values())) == len(by_word)


# 1 mixing --------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mixing_meets_targets_and_caps(spark):
    draw = random.Random(3)
    rows = []
    for k, (source, n) in enumerate([("a", 4), ("b", 120), ("é", 90), ("z", 200), (None, 60), ("empty", 3)]):
        for j in range(n):
            size = 0 if source == "empty" else draw.choice([1, 2, 3, 5, 8, 40, 41, 90])
            rows.append((1000 * k + j, " ".join("w" * 1 for _ in range(size)) if size or j else None, "en", source, 0))
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_table(docs).collect()
    again = mixing.mix_table(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1.0, 0.01 * t), s


def test_mixing_tilts_exponentially_and_survives_hot_groups(spark):
    texts = ["a b c"] * 3000 + ["d " * n for n in range(1, 60)]
    docs = spark.createDataFrame(doc_rows(texts, ["p"]) + [(9000 + i, "q " * 30, "en", "q", 0) for i in range(50)], DOCS)
    got = mixing.mix_table(docs).collect()
    inner = [r for r in got if r.source == "p" and 0 < r.rate < 3]
    mean = sum(r["size"] for r in got if r.source == "p") / 3059
    slopes = {round(np.log(r.rate) / (r["size"] / mean), 6) for r in inner}
    assert len(slopes) == 1
    for s in ("p", "q"):
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(next(r.target for r in got if r.source == s), rel=0.005)


def test_mixture_repeats_rows_and_ignores_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 7), "en", f"s{i % 3}", 0, 9, 8) for i in range(100)], DOCS + ", size int, copies int")
    plain = {r.doc_id: r.copies for r in mixing.mix_table(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    count = {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count == {k: v for k, v in plain.items() if v}
    assert mixing.mix_table(docs.limit(0)).count() == 0


# 2 html ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>A<th>Bee<tr><td rowspan=2>long<td>x<tr><td>y</table>", "A     Bee\nlong  x\n      y"),
    ("<table><tr><td>a<td><table><tr><td>n<td>m</table></table>", "a  n  m"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>';</script>y", "xy"),
    ("a<span hidden>no</span><i style='display: none'>no</i><b style='visibility:hidden'>no<u style='visibility:visible'>yes</u></b>", "ayes"),
    ("<pre> k\n  v</pre><br>z", " k\n  v\n\nz"), ("<details><summary>s</summary>no</details><details open>in</details>", "s\nin"),
    ("a<!-- no --><![CDATA[c & d]]> <bad", "ac & d <bad"), ("<td>lone</td></p></b>", "lone"), ("<blockquote>q<p>r</blockquote>t", "> q\n\n> r\n\nt"),
    ("<select><option>a<option selected>b</select>", "b"), ("x<br><br>y", "x\n\ny"),
])
def test_rendering(page, want):
    assert html.visible_text(page) == want


def test_rendering_is_linear_on_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    rows = "".join(f"<tr><td>{'w ' * 200}<td>{i}" for i in range(500))
    assert html.visible_text(deep) == "x"
    assert len(html.visible_text(f"<table>{rows}</table>")) < 400_000
    pages = spark.createDataFrame([(1, None), (1, "<p>a b"), (None, deep)], "page_id long, html string")
    got = sorted(html.extracted(pages).collect(), key=lambda r: r.text)
    assert [(r.text, r.n_lines, r.n_words) for r in got] == [("", 0, 0), ("a b", 1, 2), ("x", 1, 1)]


def test_rendering_keeps_every_visible_word_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extracted(pages.select("page_id", "html"), keep=("page_id", "html")).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", r.html)
        body = re.sub(r"<(?!/?b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")
        import html as std
        assert r.text.replace("\n- ", "\n").removeprefix("- ").split() == std.unescape(body).split()


# 3 rules ---------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for p in range(len(words) - 7):
        seen.setdefault(tuple(words[p:p + 8]), []).append(p)
    for places in seen.values():
        if len(places) > 1:
            hit |= {q for p in places for q in range(p, p + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(words) < 20 or 100 * len(hit) > 30 * len(words))


def test_rules_match_brute_force(spark):
    base = "the quick brown fox jumps over one lazy dog today"
    texts = [None, "", " \n ", "w " * 7, "w " * 8, "w " * 9, "w " * 30, base + "\n" + base + " x\n" + base, "é# $ü " * 12, "a\n\na\nb\na", "\x0b\x0ca b",
             " ".join(f"u{i}" for i in range(5000)) + " " + " ".join(f"u{i}" for i in range(40)), *random_texts(40, vocab=3), *random_texts(20)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t), t
        assert not (r.kept and r.base_failed)
    assert rules.compiled(docs).columns[2:4] == ["n_words", "n_words_"]
    assert rules.judged(docs.limit(0)).count() == 0
    alone = {r.doc_id: r.n_repeat_words for r in rules.judged(docs).select("doc_id", "n_repeat_words").collect()}
    assert alone == {i: r.n_repeat_words for i, r in got.items()}


# 4 shards --------------------------------------------------------------------------------------


def test_matrix_has_exact_margins_and_the_right_mean():
    total = np.zeros((3, 4))
    for seed in range(400):
        m = shards.communication_matrix([5, 0, 9], [4, 4, 3, 3], seed)
        assert m.sum(1).tolist() == [5, 0, 9] and m.sum(0).tolist() == [4, 4, 3, 3]
        total += [m[0], m[1], m[2]]
    assert np.allclose(total[0] / 400, 5 * np.array([4, 4, 3, 3]) / 14, atol=0.15)


def test_draws_from_large_populations_have_the_hypergeometric_law():
    draw = np.random.default_rng(3)
    for good, bad, n in ((30, 50, 20), (50, 30, 20), (9, 40, 45), (4000, 9000, 6000), (3, 2, 4)):
        mine = np.array([shards._by_rejection(draw, good, bad, n) for _ in range(20_000)])
        theirs = draw.hypergeometric(good, bad, n, 20_000)
        points = np.quantile(theirs, [0.05, 0.2, 0.4, 0.6, 0.8, 0.95])
        assert np.allclose((mine[:, None] <= points).mean(0), (theirs[:, None] <= points).mean(0), atol=0.025)
    few = np.array([shards._hypergeometric(draw, 2, 3 * 10**9, 10**9) for _ in range(5000)])
    assert abs((few == 0).mean() - 0.444) < 0.03 and abs((few == 2).mean() - 0.111) < 0.03
    big = np.array([shards._hypergeometric(draw, 10**11, 23 * 10**11, 10**10) for _ in range(5000)]) - 10**10 / 24
    assert abs(big.mean()) < 1500 and abs(big.std() / (10**10 / 24 * 23 / 24 * (1 - 1 / 240)) ** 0.5 - 1) < 0.05


def test_cut_positions_drawn_in_groups_have_exact_margins(spark):
    given = [(p, (p * 7) % 11) for p in range(60)]
    counts = spark.createDataFrame(given, "part int, n long")
    total, sums = sum(n for _, n in given), []
    for seed in range(6):
        ends = {r.part: np.array(r.ends) for r in shards.cut_positions(counts, 5, seed, fan=7).collect()}
        pieces = np.stack([np.diff(ends[p], prepend=0) for p, _ in given])
        assert (pieces >= 0).all() and pieces.sum(1).tolist() == [n for _, n in given]
        assert pieces.sum(0).tolist() == [total // 5 + (s < total % 5) for s in range(5)]
        sums.append(pieces)
    assert len({x.tobytes() for x in sums}) == 6
    assert shards.cut_positions(counts.limit(0), 5, 1).count() == 0


@pytest.mark.parametrize("n,per", [(0, 50), (5, 50), (1000, 50), (1000, 20_000)])
def test_shards_are_exact_and_slots_gapless(spark, n, per):
    rows = [(None if i % 50 == 0 else i // 3, "same" if i % 3 else None, 7) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shards.shuffled(df, 24, per_partition=per)
    assert out.columns == ["doc_id", "text", "shard", "shard_", "slot"]
    got = out.collect()
    again = shards.shuffled(df.repartition(5), 24, per_partition=per).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(map(str, rows))
    slots = {}
    for r in got:
        slots.setdefault(r.shard_, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((len(slots.get(s, [])) for s in range(24)), reverse=True) == [n // 24 + (s < n % 24) for s in range(24)]


def test_identical_rows_are_spread_over_partitions_and_shards(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN_BITS", 4)
    df = spark.createDataFrame([(1, "same")] * 1200 + [(i, None) for i in range(2, 1000)] * 2, "doc_id long, text string").repartition(7)
    out = shards.shuffled(df, 24, per_partition=50)
    per = {r.shard: r.n for r in out.where("doc_id = 1").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 24 and max(per.values()) < 90 and sum(per.values()) == 1200
    pairs = out.where("doc_id > 1").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("apart")).collect()
    assert all(r.n == 2 for r in pairs) and sum(r.apart == 2 for r in pairs) > 900
    numbers = shards.numbered(df, [F.col("doc_id"), F.col("text")], "copy", 1).groupBy("doc_id").agg(F.sort_array(F.collect_list("copy")).alias("c")).collect()
    assert all(r.c == list(range(1200 if r.doc_id == 1 else 2)) for r in numbers)


def test_manifest_measures_whole_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "é" * 1000), (2, "é" * 1000), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in shards.manifest(docs).collect())
    crc = zlib.crc32(("é" * 1000).encode())
    assert got == [(1, 8, 0, "rows", None), (2, 2008, crc, "rows", None), (2, 2008, crc, "rows", None), (3, 8, 0, "rows", None)]


def test_written_shards_hold_slot_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    path = shards.write_shards(df, str(tmp_path / "out"), shards=3)
    got = spark.read.parquet(path)
    assert got.count() == 500 and got.select("shard").distinct().count() == 3


# 5 warc ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "é\r\n\r\nWARC/1.1\r\n" * 200, "z" * 1000
    rows = [(1, "http://a.org/x", big), (9, "http://A.org/y#f", big), (5, None, big), (7, "http://b.org", "short"), (8, "http://b.org", "short"),
            (2, "", None), (3, "http://c.net/\r\nbad", other), (4, "http://c.net/", other), (4, "http://c.net/", other), (None, "http://n.net/", other)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.sound for r in got)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    first = {big: 9, other: 4}
    want = sorted(str((p, len((t or "").encode()), sha(t), "response" if first.get(t, p) == p else "revisit", None if first.get(t, p) == p else first[t])) for p, _, t in rows)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_long_pages_go_into_files_of_their_own(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", "x" * (10 * i)) for i in range(40)] + [(100, None, "y" * 5000), (101, None, "y" * 5000), (102, "http://b.org", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, str(tmp_path / "warc"), files=((100, 20), (1000, 4), (None, 1)))
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((p, len(t or "")) for p, _, t in rows) and all(r.sound for r in got)
    per_file = {}
    for r in got:
        per_file.setdefault(r.file, []).append(r.payload_bytes)
    assert all(len(x) == 1 for x in per_file.values() if max(x) > 1000) and all(len(x) <= 4 for x in per_file.values() if max(x) > 100)
    assert max(len(x) for x in per_file.values()) > 4


def test_index_lookup_and_range_reads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [(i, f"http://h{i % 9}.org/p{i // 4}", f"<p>{i}") for i in range(300)] + [(900, "http://h1.org/p1", "copy")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.read_archives(spark, warc.write_archives(pages))
    blocks, directory = warc.build_index(captures)
    assert directory.count() > 20
    wanted = [3, 40, 123, 299, 900]
    key = warc.sort_key(warc.url_key(F.col("url")), F.col("page_id"))
    keys = pages.where(F.col("page_id").isin(wanted)).select(key.alias("key")).unionByName(spark.createDataFrame([("zz,zz)/\t1",), ("",)], "key string"))
    found = warc.lookup(keys, blocks, directory)
    assert sorted(r.page_id for r in found.collect()) == wanted
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(found).collect()}
    assert payloads == {i: t for i, _, t in rows if i in wanted}
    monkeypatch.setattr(warc, "DIRECTORY_BYTES", 1)
    assert sorted(r.page_id for r in warc.lookup(keys, blocks, directory).collect()) == wanted


def test_range_reads_touch_only_the_wanted_bytes(spark, monkeypatch, tmp_path):
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>{i} é" * (1 + i % 50)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    captures = shared.stored(warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "a b"))), "captures")
    payloads = lambda found: sorted((r.page_id, bytes(r.payload).decode()) for r in warc.read_records(found).collect())
    some = captures.where("page_id % 7 = 0")
    want = [(i, h) for i, _, h in rows if i % 7 == 0]
    assert payloads(some) == want and payloads(some.unionByName(some)) == sorted(want * 2) and payloads(some.limit(0)) == []
    for size, gap, stretch in ((1, 0, 1), (300, 10, 1000), (1 << 20, 1 << 20, 1 << 20)):
        monkeypatch.setattr(warc, "READ", size)
        monkeypatch.setattr(warc, "GAP", gap)
        monkeypatch.setattr(warc, "STRETCH", stretch)
        assert payloads(some) == want
    # a damaged payload shows in the record that was read, though the index still has the old digest
    bad = captures.where("page_id = 21").first()
    with open(bad.file.removeprefix("file:"), "r+b") as f:
        f.seek(bad.offset + bad.length - 8)
        f.write(b"#")
    assert [r.page_id for r in warc.checked(captures).collect() if not r.sound] == [21]


def test_neighbouring_ranges_are_read_together():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 10), ("a", 90, 10), ("a", 90, 10), ("b", 95, 500), ("b", 595, 10)]
    assert [len(x) for x in warc.neighbours(rows, most=100, gap=5)] == [3, 2, 1, 1]
    assert list(warc.neighbours([])) == []


def test_lookup_by_ranges_reads_every_block_of_a_repeated_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [(i, f"http://h{i % 9}.org/p{i}", f"<p>{i}") for i in range(200)] + [(None, "http://h4.org/p1", f"<p>none {i}") for i in range(40)] + [(500, "http://h7.org/x", f"<p>same {i}") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    blocks, directory = warc.build_index(warc.read_archives(spark, warc.write_archives(pages)))
    assert directory.groupBy("first").count().agg(F.max("count")).first()[0] > 3
    keys = pages.select(warc.sort_key(warc.url_key(F.col("url")), F.col("page_id")).alias("key"))
    digests = lambda: sorted((r.page_id or -1, r.payload_digest) for r in warc.lookup(keys, blocks, directory).collect())
    want = sorted((p or -1, hashlib.sha1(h.encode()).hexdigest()) for p, _, h in rows)
    assert [d.split(":")[-1] for _, d in digests()] == [d for _, d in want]
    monkeypatch.setattr(warc, "DIRECTORY_BYTES", 1)
    assert [d.split(":")[-1] for _, d in digests()] == [d for _, d in want]


# 6 url filter ----------------------------------------------------------------------------------


def test_url_rules_match_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "HTTP://X.NET/en/", "http://example.net/en/a?b#c", "http://a.example.net/en/", "http://a.example.net/e",
            "ftp://example.com/de/x", "http://example.com/de", "http://notexample.com/de/", "http://example.org/fr/", "http://org/fr/", "x://net/?", "http://a.spam-farm.example.org/q",
            "http://spam-farm.example.org?x://y", "http://a.net#b/c", "http://casino-win.example.com/" + "p" * 5000, "http://.net/", "://net/x", "http://a..net/", "http://exämple.net/en/"]

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + tail
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        site = re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", host.rpartition("@")[2]))      # the list meets the canonical form
        listed = any((site == h or site.endswith("." + h)) and (path or "/").startswith(p) for h, p in urlfilter.LISTED)
        return host, path, None, "block" if listed else "allow"

    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages).collect()}
    for i, u in enumerate(urls + urls):
        assert got[i] == brute(u), u
    assert urlfilter.screened(pages, urlfilter.list_of(spark, [])).where("verdict is not null").count() == 0
    assert urlfilter.screened(pages, urlfilter.list_of(spark, [])).columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict"]


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = 5000 * urlfilter.BITS_PER_KEY // 64
    table = urlfilter.bloom_filter(keys, "key", blocks)
    probe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    bits = urlfilter.bloom_bits(F.col("key"))
    hits = probe.withColumn("bloom_block", urlfilter.bloom_block(F.col("key"), blocks)).join(table, "bloom_block").where(F.col("bloom_bits").bitwiseAND(bits) == bits)
    inside = hits.where("cast(substr(key, 2) as int) < 5000").count()
    assert inside == 5000 and hits.count() - inside < 1500


# 7 licences ------------------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("LICENSE", mit), ("a/LICENSE.txt", "some words\n" + gpl), ("a/b/x.py", "plain words here\nthat say nothing"), ("a/b/c/y.py", "first\n" + mit + "\nlast"),
             ("z.py", None), ("q/r/s.py", ""), (None, "nothing"), ("a/b/COPYING", "no licence here"), ("z.py", None), ("d/e.py", "x " * 20_000)]
    df = spark.createDataFrame([(*f, 1) for f in files], "path string, text string, license_x int")
    got = {(r.path, r.own_license, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {("LICENSE", "MIT", "MIT", None), ("a/LICENSE.txt", "GPL-3.0", "GPL-3.0", None), ("a/b/x.py", None, "GPL-3.0", "a"), ("a/b/c/y.py", "MIT", "MIT", None),
                   ("z.py", None, "MIT", ""), ("q/r/s.py", None, "MIT", ""), (None, None, None, None), ("a/b/COPYING", None, "GPL-3.0", "a"), ("d/e.py", None, "MIT", "")}
    assert licenses.scan(df).count() == len(files) and licenses.scan(df.limit(0)).count() == 0


def test_licence_cosine_matches_direct_computation(spark):
    texts = ["licensed under the apache license, version 2.0", "the license of the public house\nmit license released", *random_texts(15)]
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: r.own_score for r in licenses.scored(df).collect()}
    find = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())
    templates = [find(t) for _, t in licenses.TEMPLATES]
    vocab = sorted({w for t in templates for w in t})
    lines = [(i, find(x)) for i, t in enumerate(texts) for x in t.split("\n") if find(x)]
    df_ = {w: sum(w in x for _, x in lines) for w in vocab}
    idf = {w: np.log((1 + len(lines)) / (1 + df_[w])) + 1 for w in vocab}
    rare = np.log(1 + len(lines)) + 1
    best = {}
    for i, x in lines:
        mine = {w: x.count(w) * idf[w] for w in set(x) if w in idf}
        norm = np.sqrt(sum(v * v for v in mine.values()) + sum(w not in idf for w in x) * rare**2)
        for t in templates:
            tv = {w: t.count(w) * idf[w] for w in set(t)}
            cos = sum(mine.get(w, 0) * v for w, v in tv.items()) / norm / np.sqrt(sum(v * v for v in tv.values()))
            best[i] = max(best.get(i, 0), cos)
    for i in range(len(texts)):
        assert got[f"f{i}"] == pytest.approx(best.get(i, 0), abs=1e-6)


def test_licences_of_wrapped_headers_and_whole_texts(spark):
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 70))
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
           "Foundation, either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY "
           "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.")
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    code, more = "#!/bin/sh\nCopyright (c) 2001 Jane Doe\n\n", "\n\n" + "\n".join(random_texts(60))
    files = [("a/x.py", code + wrap(gpl.format(3), "# ") + more, "GPL-3.0"), ("a/y.c", code + wrap(gpl.format(2), " * ") + more, "GPL-2.0"), ("a/z.m4", code + wrap(gpl.format(2), "dnl ") + more, "GPL-2.0"),
             ("a/l.c", code + wrap(gpl.format(3).replace("General", "Lesser General"), "// ") + more, "LGPL-3.0"), ("a/f.c", code + wrap(gpl.format(3).replace("General", "Affero General"), "// ") + more, "AGPL-3.0"),
             ("a/b.c", code + wrap(bsd, " * ") + more, "BSD-3-Clause"), ("a/plain.c", more, None),
             ("a/long.md", "word " * 50 + "Released under the MIT License " + "other " * 50, "MIT"),
             *[(f"{n}/LICENSE", "Title of the project\nCopyright (c) 2001 Jane Doe\n\n" + licenses._full(n), n)
               for n in ("0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MIT", "Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")]]
    inner = [(f"{f[0].split('/')[0]}/src/x.c", "int main", f[2]) for f in files if f[0].endswith("LICENSE")]
    df = spark.createDataFrame([f[:2] for f in files + inner], "path string, text string")
    got = {r.path: r.license for r in licenses.scan(df).collect()}
    assert got == {p: n for p, _, n in files + inner}


def test_licences_keep_given_columns_of_the_new_names(spark):
    mit = "Released under the MIT License"
    rows = [("a/LICENSE", mit, "x", 1, "g", "f", True, "p"), ("a/b/c.txt", "nothing here", "y", 2, "h", "f", False, "q"), (None, None, None, None, None, None, None, None)]
    files = spark.createDataFrame(rows, "path string, text string, own_license string, own_score int, license string, in_folder string, whole boolean, above string")
    got = {r.path: r.asDict() for r in licenses.scan(files).collect()}
    assert [got[p]["license_"] for p in ("a/LICENSE", "a/b/c.txt", None)] == ["MIT", "MIT", None] and got["a/b/c.txt"]["inherited_from"] == "a"
    assert got["a/b/c.txt"]["own_license_"] is None and got["a/LICENSE"]["own_license_"] == "MIT"
    for path, _, *given in rows:
        assert [got[path][c] for c in ("own_license", "own_score", "license", "in_folder", "whole", "above")] == given


def test_lines_meet_templates_in_slices(monkeypatch):
    draw = np.random.default_rng(3)
    weight, n, k = draw.random(40) + 0.5, 300, 7
    matrix = draw.random((40, k))
    matrix /= np.linalg.norm(matrix, axis=0)
    unit = np.sort(draw.integers(0, n, 2000))
    term = draw.integers(-1, 40, 2000)
    _, unit = np.unique(unit, return_inverse=True)
    n = unit.max() + 1
    worth = np.zeros(k)
    want = []
    for u in range(n):
        own = term[unit == u]
        vector = np.bincount(own[own >= 0], minlength=40) * weight
        cosine = vector @ matrix / np.sqrt((vector**2).sum() + (own < 0).sum() * 4.0)
        want.append((np.where(cosine >= 0.3, cosine, cosine - 1).round(9).argmax(), cosine))
    for pairs in (1, 3, 50, 1 << 20):
        monkeypatch.setattr(licenses, "PAIRS", pairs)
        top, high = licenses.best_templates(term, unit, n, weight, 2.0, matrix, worth, 0.3)
        assert top.tolist() == [w[0] for w in want]
        assert np.allclose(high, [c[t] for t, c in want])


# 8 quality -------------------------------------------------------------------------------------


def test_quality_learns_without_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    hidden = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r for r in quality.judged(docs.repartition(3), hidden).collect()}
    assert got == again
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "w " * 50_000, 5), (2, "w " * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.accepted(docs, labels, 0.0).columns == docs.columns
    both = quality.scored(docs, quality.train(docs, labels))
    assert both.columns == [*docs.columns, "score_"] and {r.score for r in both.collect()} == {5}
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_trees_fit_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((4000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    model = quality.fit(x, y)
    fresh_x = draw.random((2000, x.shape[1]))
    assert np.mean((model.score(fresh_x) > 0.5) == ((fresh_x[:, 2] > 0.5) ^ (fresh_x[:, 7] > 0.3))) > 0.97
    assert len(model.score(x[:0])) == 0


# 9 decontamination -----------------------------------------------------------------------------


def brute_hits(text, items, width):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = find(text), set(), set()
    for name, t in items:
        w = find(t)
        n = min(width, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for q in range(len(words) - n + 1):
                if words[q:q + n] == w[p:p + n]:
                    hit |= set(range(q, q + n))
                    names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("vocab,width,block,machines", [(2, 4, 1 << 20, 16), (4, 3, 1 << 20, 16), (12, 10, 300, 16), (3, 5, 200, 16), (4, 5, 150, 2)])
def test_automaton_matches_brute_force(spark, vocab, width, block, machines):
    draw = random.Random(vocab)
    word = [f"w{k}" for k in range(vocab)]
    items = [(str(k), " ".join(draw.choice(word) for _ in range(draw.choice([0, 1, 2, 4, 9, 25])))) for k in range(14)] + [("x", None), ("3", "w0 w1 w0")]
    texts = [None, "", *(" ".join(draw.choice([*word, "other"]) for _ in range(draw.randint(0, 60))) for _ in range(40)), *(t for _, t in items[:6])]
    texts += [f"A-{items[5][1]}, {items[9][1].upper()}!"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    table = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontam.scan(docs, table, width=width, block_bytes=block, machines=machines, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute_hits(t, items, width), t
        assert got[i].n_items == len(got[i]["items"]) and got[i].n_hit == sum(s.end - s.first for s in got[i].spans)
        assert all(a.end < b.first for a, b in itertools.pairwise(got[i].spans))


def test_automata_are_built_once_per_distinct_item_and_loaded_pass_by_pass(spark):
    rows = [(str(k), " ".join(f"w{k}x{j}" for j in range(12))) for k in range(30)]
    items = spark.createDataFrame(rows + [rows[3]] * 3000 + [(None, rows[5][1]), ("e", ""), ("n", None)], "item_id string, text string")
    made = decontam.passes(items, "item_id", "text", 10, block_bytes=400, machines=2)
    assert made.blocks == -(-sum(len(t) for _, t in [*rows, rows[5]]) // 400)
    sent = [[decontam.Automaton.of(b.value) for b in one] for one in made]
    assert len(sent) == len(made) == -(-made.blocks // 2) and max(len(x) for x in sent) == 2
    names = [n for one in sent for machine in one for n in machine.names]
    assert sorted(n or "" for n in names) == sorted([n for n, _ in rows] + [""])
    docs = spark.createDataFrame([(1, f"so {rows[3][1]} {rows[5][1]}"), (2, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in decontam.scan(docs, items, block_bytes=400, machines=2).collect()}
    assert got == {1: (24, 3, ["3", "5"]), 2: (0, 0, [])}


def test_decontamination_removes_cuts_and_keeps(spark):
    item = " ".join(f"b{k}" for k in range(12))
    clean = " ".join(f"c{k}" for k in range(200))
    halves = " ".join(f"b{k}" for k in range(6)) + " " + item + " " + " ".join(f"b{k}" for k in range(6, 12)) + " " + clean
    docs = spark.createDataFrame([(1, clean, 0), (2, clean + "\n" + item, 0), (3, item, 0), (4, halves, 0), (5, None, 0), (1, clean, 0)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    dropped = decontam.decontaminate(docs, items)
    assert dropped.columns == docs.columns and sorted(r.doc_id for r in dropped.collect()) == [1, 1, 5]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, items, max_words=30, max_coverage=0.5).collect()}
    assert sorted(cut) == [1, 2, 4, 5] and cut[2].split() == clean.split()
    assert brute_hits(cut[4], [("7", item)], 10)[1] == 0 and cut[4].split()[-200:] == clean.split()
    two = items.unionByName(spark.createDataFrame([(8, item.replace("b", "d")), (9, "d0 d1")], items.schema))
    both = {r.doc_id: r.text for r in decontam.decontaminate(docs, two, max_words=30, max_coverage=0.5, block_bytes=40, machines=1).collect()}
    assert {k: (v or "").split() for k, v in both.items()} == {k: (v or "").split() for k, v in cut.items()}
    assert decontam.decontaminate(docs, items.limit(0)).count() == 6 and decontam.decontaminate(docs.limit(0), items).count() == 0
    digest = {r.doc_id: r for r in decontam.contaminated(docs, items).collect()}
    assert digest[3].items_sha256 == hashlib.sha256(b"7").hexdigest() and digest[5].items_sha256 == hashlib.sha256(b"").hexdigest()


# 10 Jaccard join -------------------------------------------------------------------------------


def brute_join(texts):
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[p:p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {i: set() for i in texts}
    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for i in texts:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), min([i, *(j for j in links[i] if sets[j] == sets[i])]), 1 + sum(sets[j] == sets[i] for j in links[i]), len(links[i]))
    return out


@pytest.mark.parametrize("block", [8, 256])
def test_join_matches_brute_force(spark, block):
    draw = random.Random(4)
    base = [" ".join(f"v{draw.randrange(500)}" for _ in range(draw.choice([3, 30, 120]))) for _ in range(25)]
    texts = {0: None, 1: "", 2: " \n"}
    for k, t in enumerate(base):
        for j in range(draw.choice([1, 1, 3, 12])):
            w = t.split()
            for _ in range(draw.randint(0, 2)):
                w[draw.randrange(len(w))] = "edit"
            texts[10 + 20 * k + j] = " ".join(w) if j % 3 else t.upper()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, rep int")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in jaccard.join(docs, block=block).collect()}
    assert got == brute_join(texts)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, *_ in got.values()})


def test_join_edge_cases(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, ""), (3, None), (4, "a b"), (4, "A  b")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1, 4, 3), (1, 1, 1, 4, 3), (2, 1, 1, 4, 3), (None, 1, 1, 4, 3), (None, None, None, 1, 0), (3, 3, 3, 1, 0), (4, 4, 4, 2, 1), (4, 4, 4, 2, 1)], key=str)
    assert jaccard.join(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs).where("doc_id = 1").count() == 1


def test_join_keeps_sets_apart_that_share_a_doc_id_or_have_none(spark):
    def text(mark, changed=0):
        return " ".join(f"{mark}{k}" if k >= changed else f"{mark}new{k}" for k in range(60))

    rows = [(1, text("a")), (2, text("a", 1)), (1, text("b")), (3, text("b", 1)), (3, text("c")), (None, text("d")), (None, text("d", 1)), (None, text("d", 1)),
            (4, text("e")), (None, text("e", 1)), (None, text("e", 2)), (5, ""), (5, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, {"k": "v"}) for d, t in rows], "doc_id long, text string, set_key map<string,string>")
    got = sorted(map(tuple, jaccard.join(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1, 1, 1), (2, 1, 2, 1, 1), (1, 1, 1, 1, 1), (3, 1, 3, 1, 1), (3, 3, 3, 1, 0), (None, None, None, 1, 2), (None, None, None, 2, 2), (None, None, None, 2, 2),
                          (4, 4, 4, 1, 2), (None, 4, None, 1, 2), (None, 4, None, 1, 2), (5, 5, 5, 1, 0), (5, 5, 5, 1, 0), (None, None, None, 1, 0), (None, None, None, 1, 0)], key=str)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    one = [x for x in left if x[0] is None and (x[1] or "").startswith("d")]
    assert len(one) == 1
    assert left == sorted([(1, text("a")), (1, text("b")), (3, text("c")), one[0], (4, text("e")), (5, ""), (None, ""), (None, None)], key=str)


def test_pruning_bounds_are_the_beta_tail():
    draw = np.random.default_rng(1).beta(21, 13, 200_000)
    assert jaccard.beta_above(21, 13, 0.7) == pytest.approx((draw > 0.7).mean(), abs=0.005)
    steps = jaccard.cutoffs(160, 32, 0.8, 1e-6)
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160] and all(need < 0.8 * n for n, need in steps)


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in touched}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
