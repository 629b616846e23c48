"""Personal data, collocations and source divergence against brute force on small hand-made tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import divergence, personal, phrases, quotient, wordchunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, spot string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, "x") for i, (t, lang, source) in enumerate(rows)], DOCS)


def prose(draw, words, n):
    return "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "!?"]) for _ in range(n))


# quotient filters ------------------------------------------------------------------------------


@pytest.mark.parametrize("largest,bits,shards", [(9, 16, 1), (2**21 - 1, 16, 8), (2**21, 16, 4), (2**32 - 1, 24, 64)])
def test_filters_are_lossless(largest, bits, shards):
    layout = quotient.Layout(largest, bits, shards)
    draw = np.random.default_rng(1)
    a, b, c = (draw.integers(k, largest, 5000, endpoint=True) for k in (0, 1, 1))
    a[:50], b[:50], c[:50] = 0, largest, 1
    left, right = layout.packed(a, b, c)
    assert all((x == y).all() for x, y in zip(layout.unpacked(left, right), (a, b, c), strict=True))
    entries = quotient.counted(layout, left, right)
    counts = collections.Counter(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))
    assert dict(zip(zip(*(x.tolist() for x in layout.unpacked(*entries[:2])), strict=True), entries[2].tolist(), strict=True)) == counts
    twice = quotient.merged(layout, [entries, tuple(x[::2] for x in entries), (entries[0], entries[1], entries[2] + 10**12)])
    border = np.searchsorted(layout.shard_of(twice[0]), np.arange(shards + 1, dtype=np.uint64))
    back = []
    for s in range(shards):
        part = tuple(x[border[s]:border[s + 1]] for x in twice)
        if len(part[0]):
            back.append(quotient.read(layout, quotient.written(layout, part, s), s))
    assert all((np.concatenate([p[i] for p in back]) == twice[i]).all() for i in range(3))
    assert twice[2].sum() == 2 * entries[2].sum() + entries[2][::2].sum() + 10**12 * len(entries[2])


# 12 collocations -------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (phrase.decode(), a, left, right, n[lang], -score)
    return out


@pytest.mark.parametrize("flush", [None, 300])
def test_collocations_against_brute_force(spark, monkeypatch, flush):
    draw = random.Random(12)
    words = ["a", "B", "b", "ab", "É", "é", "x\x00", "x\x01", "日本", "zz", "q-1"]
    rows = [(prose(draw, words[: draw.randint(2, 11)], draw.randint(0, 300)), draw.choice(["en", "de", None, "und", ""]), "s") for _ in range(60)]
    rows += [(None, "en", "s"), ("", None, None), ("a a a a a a a a a a a a a a", "rare", "s"), ("only", "short", "s"), rows[0], rows[0]]
    rows.append((" ".join(["long", "tail", "of"] * 4000), "big", "s"))
    if flush:
        monkeypatch.setattr(phrases, "FLUSH", flush)
        monkeypatch.setattr(phrases, "SHARD", 2000)
        monkeypatch.setattr(wordchunks, "CHUNK_BYTES", 500)
    got = phrases.collocations(table(spark, rows).repartition(5), top=40).collect()
    want = brute_phrases(rows, 10, 40)
    assert {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want
    assert len(got) == len(want) > 50


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(table(spark, [("a b", "en", "s")]).where("doc_id < 0")).collect() == []
    assert phrases.collocations(table(spark, [("a b", "en", "s")])).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**14
    row = spark.range(1).select(F.lit(big).cast("long").alias("a"), F.lit(big + 12345).cast("long").alias("l"), F.lit(big + 1).cast("long").alias("r"))
    assert row.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * big * big // ((big + 12345) * (big + 1))


# 13 divergence ---------------------------------------------------------------------------------


def brute_audit(rows, min_df=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_df]
        groups = {d[1]: collections.Counter() for d in docs if d[0] == lang}
        for d in docs:
            if d[0] == lang:
                groups[d[1]].update(t for t in d[2] if df[t] >= min_df)
        whole = sum(groups.values(), collections.Counter())

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {g: shares(c) for g, c in groups.items()}, shares(whole)
        f = lambda x, y: (x - y) * (x - y) // y
        for g in groups:
            pairs = [(-sum(f(p[g][t], p[h][t]) for t in kept), h.encode()) for h in groups if h != g]
            terms = [(-f(p[g][t], q[t]), t.encode()) for t in kept if groups[g][t] > 0 and p[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                for rank, (value, item) in enumerate(found, 1):
                    out[lang, g, part, rank] = (item.decode(), -value)
    return out


@pytest.mark.parametrize("tile,terms", [(32, 4096), (2, 3)])
def test_divergence_against_brute_force(spark, monkeypatch, tile, terms):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    draw = random.Random(13)
    words = ["Alpha", "beta", "BETA", "é", "É", "日本", "x1y", "don't", "ß", "gamma"]
    rows = [(prose(draw, words[: draw.randint(1, 10)], draw.randint(0, 40)), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "é", None, "s3"])) for _ in range(90)]
    rows += [(None, "en", "bare"), ("", "fr", "a"), (None, "fr", "b"), ("one two", "it", "alone"), rows[0], rows[0], ("12 !", "en", ""), ("w " * 30000, "en", "s1")]
    got = divergence.audit(table(spark, rows).repartition(6), top=4).collect()
    want = brute_audit(rows, top=4)
    assert {(r.lang, r.source, r.part, r["rank"]): (r.item, r.value) for r in got} == want
    assert len(got) == len(want) and ("fr", "a", "pair", 1) in want
    assert divergence.audit(table(spark, rows).where("doc_id < 0")).collect() == []


def test_divergence_of_the_largest_counts(spark):
    rows = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "count long, total long, size long")
    assert rows.select(divergence.share(F.col("count"), F.col("total"), F.col("size"))).first()[0] == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7)


def test_document_vectors_are_exact(spark):
    docs = table(spark, [("a b a", "en", "s"), ("b A", "en", "t"), ("a", "en", None), (None, "de", "s"), ("c c c", "de", "s")])
    vocabulary = divergence.count_vectorizer(divergence.group_sums(docs), min_df=2)
    words = {r.id: r.word for r in vocabulary.collect()}
    assert sorted(words) == [1, 2]
    got = {r.doc_id: (r.lang, r.source, {words[x["id"]]: x["count"] for x in r.vector}) for r in divergence.document_vectors(docs, vocabulary).collect()}
    assert got == {0: ("en", "s", {"a": 2, "b": 1}), 1: ("en", "t", {"a": 1, "b": 1}), 2: ("en", "", {"a": 1})}
    assert [r.word for r in divergence.count_vectorizer(divergence.group_sums(docs), min_df=1, vocab_size=1).where("lang = 'en'").collect()] == ["a"]


# 11 personal data ------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def card(draw, n=16):
    digits = "4" + "".join(draw.choice("0123456789") for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group(0))
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group(0).split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def private_rows():
    draw = random.Random(11)
    rows = []
    for i in range(160):
        words = ["word" + draw.choice("abcdé") for _ in range(12)]
        spot = draw.randint(1, 10)
        number = "".join(draw.choice("123456789") for _ in range(10))
        own = [f"{draw.choice('abcdef')}{i}@mail{i % 7}.example.com", f"{draw.randint(1, 255)}.{draw.randint(0, 255)}.{draw.randint(0, 255)}.{draw.randint(0, 255)}", card(draw),
               f"+1 ({number[:3]}) {number[3:6]}-{number[6:]}"][i % 4]
        rows.append(" ".join(words[:spot] + [own] + words[spot:]))
    odd = ["a@b.c_x@d.e.f", "x@y", "@a.b", "1.2.3.4.5.6.7.8", "0256.1.1.1 000255.0.0.01", "999.1.1.1", "🙂é a.b@c.d 🙂 1.2.3.4", card(draw)[:4] + " " + card(draw)[4:], "+1234567 +12345678 +1 (23) 45-6.7 8)", "+" + "1" * 40,
           None, "", "1" * 5000, "a" * 5000 + "@" + "b.c" * 2000, "+1 2" * 500, "1-2 3--4", card(draw, 19), "4 " * 16, rows[0], rows[0], "price at shop. nothing dot else", "version 3. CC BY-NC 4.0."]
    return rows + odd


def test_personal_examples_are_of_all_spans(spark):
    text = " ".join(f"user{i}x{i * 7}@host{i}.example.org," for i in range(700))
    docs = table(spark, [(text if k < 2 else f"call +49 30 {k}{k}1234567", "en", "s") for k in range(5)])
    spans = personal.spans_of(personal.matched(docs, ["doc_id"]))
    chosen = personal._chosen(spans)
    assert chosen.where("kind = 'email' and right").select("text").distinct().count() == 700
    rows = personal.counted(spans)
    made = personal._examples(chosen).where("text is not null")
    assert rows.agg({"n": "sum"}).first()[0] == made.count() and rows.where("held").agg({"n": "sum"}).first()[0] == made.where("pmod(hash, 4) = 0").count() > 0


def test_personal_data_against_brute_force(spark):
    texts = private_rows()
    rows = [(t, "en", "s") for t in texts]
    got = {r.doc_id: r for r in personal.personal(table(spark, rows).repartition(4)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(got[i].spans.split(",")) | ({""} if not want else set())
        assert len([s for s in got[i].spans.split(",") if s]) == len(want) + got[i].n_added
    # the prose and version rows gain nothing
    assert got[len(texts) - 1].spans == got[len(texts) - 2].spans == ""


def test_trees_add_respelled_spans(spark):
    draw = random.Random(5)
    glued = f"{card(draw)} {card(draw)}"
    dotted = ".".join(re.findall("....", card(draw)))
    extra = [glued, dotted, "d77 at mail3 dot example dot com", "d77[at]mail3.example.com", "10[.]20[.]30[.]40"]
    docs = table(spark, [(t, "en", "s") for t in [*private_rows()[:160], *(f"worda wordb {x} wordc" for x in extra)]])
    got = {r.doc_id: r.spans for r in personal.personal(docs).where("doc_id >= 160").collect()}
    assert got[160] == "card:12:28,card:29:45"
    assert got[161] == "card:12:31"
    assert got[162] == f"email:12:{12 + len(extra[2])}" and got[163] == f"email:12:{12 + len(extra[3])}"
    assert got[164] == f"ip:12:{12 + len(extra[4])}"


def test_redacted_texts_and_empty_tables(spark):
    docs = table(spark, [("é x@y.z and 1.2.3.4", "en", "s"), (None, "en", "s"), ("clean", None, None)]).withColumn("redacted", F.lit(1))
    got = personal.redacted(docs)
    assert got.columns == [*docs.columns, "redacted_"]
    assert [r.redacted_ for r in got.orderBy("doc_id").collect()] == ["é [EMAIL] and [IP]", None, "clean"]
    empty = docs.where("doc_id < 0")
    assert personal.personal(empty).collect() == [] and personal.redacted(empty).collect() == []
