"""DuckDB oracle SQL for every checked query key.

Every statement starts from the fixture CTEs of FIXTURES.md (``e`` entries, ``r`` responses with
their weighted totals), adds ``rs`` (responses with their rank) and then states the query's own
semantics in plain SQL, independently of the Spark code.
"""

FIXTURE_CTES = """
tpl(tid, query) AS (VALUES
 (0,'Implement a python routine that merges two sorted lists'),
 (1,'Prove that the sum of two even integers is even'),
 (2,'What is the capital of Peru?'),
 (3,'Compare row stores and column stores, list pros and cons and a trade-off'),
 (4,'Explain how tides form'),
 (5,'Write a poem on rain'),
 (6,'Should cities ban cars? Is it fair? Give an opinion'),
 (7,'Outline, step by step, how to plan, prove and optimize a data architecture, then compare batch and stream layouts. Which one wins? Why?'),
 (8,'Is this claim a paradox: nobody deduces what everybody implies'),
 (9,'Tell me something nice today'),
 (10,'What is the probability of two sixes'),
 (11,'Define entropy'),
 (12,'If it rains then the road is wet; it could be wet anyway, so what do you say follows from a wet road in a town where it has not rained for a whole week and nobody has washed any street, roof, car, yard, path, wall or fence since the last dry day of the long past winter?'),
 (13,'Who was first to reach the south pole and when did that happen'),
 (14,'Outline step by step a plan to move house this coming week? What do we pack first, and what do we pack last of all?')),
e AS (
 SELECT o.o_orderkey AS entry_id, o.o_orderkey AS seq, o.o_orderdate AS ts, t.tid AS tid, concat_ws(' ', u.u_text, t.query) AS query,
  CASE substr(o.o_orderpriority,1,1) WHEN '1' THEN 'best_of_n' WHEN '2' THEN 'weighted_merge' WHEN '3' THEN 'debate' WHEN '4' THEN 'chain_of_verification' END AS strategy,
  CASE WHEN t.tid = 5 THEN CAST(800 + (o.o_orderkey * 7919) % 201 AS DOUBLE) ELSE CAST((o.o_orderkey * 7919) % 1001 AS DOUBLE) END / CAST(1000 AS DOUBLE) AS confidence,
  CASE WHEN o.o_orderkey % 11 = 0 THEN '' WHEN o.o_orderkey % 11 = 1 THEN 'Too short.' ELSE d.text END AS final_answer,
  CASE WHEN o.o_orderstatus = 'P' AND t.tid <> 5 THEN 1 ELSE 0 END AS n_disagreements,
  CAST(o.o_orderkey % 4 AS INT) AS n_consensus
 FROM orders o JOIN tpl t ON o.o_orderkey % 15 = t.tid
 LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT max(doc_id) + 1 FROM documents)
 LEFT JOIN (SELECT conv_id, turn, min(translate(text, chr(13) || chr(10), '  ')) AS u_text FROM conversations WHERE role = 'user' GROUP BY conv_id, turn) u
  ON u.conv_id = o.o_orderkey % (SELECT max(conv_id) + 1 FROM conversations)
  AND u.turn = floor(o.o_orderkey / (SELECT max(conv_id) + 1 FROM conversations)) % 8),
r0 AS (
 SELECT l_orderkey AS entry_id, l_orderkey % 15 AS tid,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS response_index,
  l_suppkey % 6 AS m, l_extendedprice / CAST(10 AS DOUBLE) AS latency_ms,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Timed out after 120s' END AS error,
  (l_partkey*31 + l_linenumber*7) % 101 AS a, (l_partkey*17 + l_suppkey*3) % 101 AS c, (l_suppkey*13 + l_linenumber*29) % 101 AS g, (l_partkey*5 + l_orderkey*11) % 101 AS y,
  l_partkey
 FROM lineitem),
r1 AS (
 SELECT entry_id, response_index, m, latency_ms, error, l_partkey,
  CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN tid = 5 THEN 88 + a % 13 ELSE floor(a * (10 - m) / 10) END AS DOUBLE) / CAST(100 AS DOUBLE) AS accuracy,
  CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN tid = 5 THEN 88 + c % 13 ELSE floor(c * (10 - m) / 10) END AS DOUBLE) / CAST(100 AS DOUBLE) AS completeness,
  CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN tid = 5 THEN 88 + g % 13 ELSE floor(g * (10 - m) / 10) END AS DOUBLE) / CAST(100 AS DOUBLE) AS reasoning_quality,
  CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN tid = 5 THEN 88 + y % 13 ELSE floor(y * (10 - m) / 10) END AS DOUBLE) / CAST(100 AS DOUBLE) AS clarity
 FROM r0),
r AS (
 SELECT r1.entry_id, r1.response_index, concat('model_', CAST(r1.m AS VARCHAR(4))) AS model_name,
  concat('m', CAST(r1.m AS VARCHAR(4))) AS model_id, concat('prov_', CAST(r1.m % 3 AS VARCHAR(4))) AS provider,
  CASE WHEN r1.error IS NOT NULL THEN '' ELSE d.text END AS content,
  r1.latency_ms, r1.error, accuracy, completeness, reasoning_quality, clarity,
  accuracy * CAST(0.35 AS DOUBLE) + completeness * CAST(0.25 AS DOUBLE) + reasoning_quality * CAST(0.20 AS DOUBLE) + clarity * CAST(0.10 AS DOUBLE) AS total_score
 FROM r1 LEFT JOIN documents d ON d.doc_id = r1.l_partkey % (SELECT max(doc_id) + 1 FROM documents))
"""

RANKED_CTE = """
rs AS (
 SELECT r.*, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY total_score DESC, response_index) AS INTEGER) AS rnk
 FROM r)
"""


def with_fixture(*ctes: str, select: str) -> str:
    parts = [FIXTURE_CTES.strip(), RANKED_CTE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()
