"""DuckDB statements of the registered corpus queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, lens WHERE len(w) >= n),
dwin AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM pos),
hit AS (SELECT doc_id, dwin.n, p, item_id FROM dwin JOIN win USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP10 = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT x, y, k = nx.n AND k = ny.n AS equal FROM link JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE k >= 0.8 * (nx.n + ny.n - k) - 1e-9),
reach AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS class_id,
       least(doc_id, coalesce((SELECT min(y) FROM edge WHERE x = doc_id AND equal), doc_id)) AS copy_id,
       1 + (SELECT count(*) FROM edge WHERE x = doc_id AND equal) AS n_copies,
       (SELECT count(*) FROM edge WHERE x = doc_id) AS n_links
FROM dw"""

_RULES = "(VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(verdict, h, p)"

OP6 = rf"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
c AS (SELECT page_id, regexp_replace(rest, '[?#].*', '', 's') AS rest FROM u),
s AS (SELECT page_id, coalesce(translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(substr(rest, length(split_part(rest, '/', 1)) + 1), '') AS path FROM c),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
        FROM s JOIN {_RULES} ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''),
       '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN fit USING (page_id)"""

_STOP = "['the', 'of', 'and', 'to', 'a', 'in', 'is', 'that', 'for', 'on', 'with', 'as', 'this', 'was', 'it', 'der', 'die', 'das', 'und', 'den', 'von', 'zu', 'mit', 'ist', 'ein', 'eine', 'im', 'nicht', 'des', 'le', 'la', 'les', 'de', 'et', 'un', 'une', 'que', 'dans', 'pour', 'est', 'du', 'en', 'au', 'el', 'los', 'las', 'y', 'por', 'con', 'una', 'para', 'se', 'del']"

OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS p FROM t WHERE len(w) >= 8)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + 7)) AS q FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: list_contains({_STOP}, lower(x)))) AS n_stop,
             len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_exclaimed FROM t LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS d,
  list_filter([CASE WHEN n_words < 20 THEN 'enough_words' END, CASE WHEN n_repeat_words > 0.3 * greatest(n_words, 1) THEN 'repeated_words' END,
   CASE WHEN word_chars < 2 * n_words OR n_words = 0 THEN 'mean_word_length' END, CASE WHEN word_chars > 12 * n_words THEN 'long_words' END,
   CASE WHEN n_symbols > 0.1 * n_words AND n_words > 0 THEN 'symbols' END, CASE WHEN n_dup_lines > 0.3 * n_lines THEN 'duplicate_lines' END,
   CASE WHEN n_stop < 0.02 * n_words OR n_words = 0 THEN 'stop_words' END, CASE WHEN n_distinct < 0.01 * n_words OR n_words = 0 THEN 'distinct_words' END,
   CASE WHEN n_exclaimed > 0.1 * n_words THEN 'exclaimed_words' END], lambda x: x IS NOT NULL) AS f FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       len(f) = 0 AND NOT base_failed AS kept, array_to_string(f, ',') AS failed FROM v"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS sound
FROM d LEFT JOIN f USING (payload_digest)"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
halves AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
         FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM cand)),
cuts AS (SELECT c.lang, c.k, c.phrase, a, h.f AS l, t.f AS r, cut, 1000000::HUGEINT * a * a // (CAST(h.f AS HUGEINT) * t.f) AS score
         FROM halves c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.part = b.phrase AND b.k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
                  row_number() OVER () AS r FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS n FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM o JOIN kept USING (lang, t) GROUP BY lang, source, t),
gn AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, gn.source, t, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (gn.n + v.v) AS p, coalesce(c.n, 0) AS n
      FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
q AS (SELECT lang, t, 1 + 1000000000::HUGEINT * (kept.n + 1) // (v.n + v.v) AS q FROM kept JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
         UNION ALL
         SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM part)
SELECT lang, source, part, item, value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 200"""

ORACLES = {"op5_warc_index": OP5, "op3_quality_rules": OP3, "op6_bloom_url_filter": OP6, "op9_benchmark_decontamination": OP9, "op10_ngram_jaccard_join": OP10,
           "op12_quotient_collocations": OP12, "op13_source_divergence": OP13}
