"""DuckDB SQL for the checked queries: the same semantics stated in plain SQL over the driver's
tables, independently of the Spark code (only the fixed rule data is shared)."""

from __future__ import annotations

from chorus.functions import defaults as D
from chorus.functions import rules as R
from chorus.oracle_base import with_fixture

WS = R.PY_WHITESPACE_CLASS
DEC = "DECIMAL(18,9)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def classify(q: str) -> str:
    parts = []
    for t, words in R.QUESTION_TYPE_RULES:
        cond = " OR ".join(f"contains(lower({q}), {_lit(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {_lit(t)}")
    return "(CASE " + " ".join(parts) + f" ELSE {_lit(R.DEFAULT_QUESTION_TYPE)} END)"


def _any(lq: str, words) -> str:
    return "(" + " OR ".join(f"contains({lq}, {_lit(w)})" for w in words) + ")"


def word_count(q: str) -> str:
    return f"len(list_filter(regexp_split_to_array({q}, '{WS}+'), lambda x: x <> ''))"


def difficulty(q: str) -> str:
    lq = f"lower({q})"
    wc = word_count(q)
    hard = (f"(CAST({wc} > {R.HARD_WORD_LIMIT} AS INT) + CAST(contains({lq}, 'step by step') AS INT)"
            f" + CAST(contains({lq}, 'compare') AND contains({lq}, 'and') AS INT) + CAST({_any(lq, R.HARD_TERMS)} AS INT)"
            f" + CAST((length({q}) - length(replace({q}, '?', ''))) > 1 AS INT))")
    easy = f"(CAST({wc} < {R.EASY_WORD_LIMIT} AS INT) + CAST({_any(lq, R.EASY_TERMS)} AS INT))"
    sc = f"({hard} - {easy})"
    return (f"(CASE WHEN {sc} >= 3 THEN 'expert' WHEN {sc} >= 2 THEN 'hard' WHEN {sc} >= 1 THEN 'medium'"
            f" WHEN {easy} >= 2 THEN 'trivial' ELSE 'easy' END)")


def categories(q: str) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches(lower({q}), {_lit('(' + '|'.join(p) + ')')}) THEN {_lit(c)} END"
        for c, p in R.WEAKNESS_CATEGORIES)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return f"(CASE WHEN len({lst}) > 0 THEN {lst} ELSE ['general'] END)"


def pct0(x: str) -> str:
    return f"(printf('%.0f', ({x}) * 100) || '%')"


def exact_avg(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS {DEC})) AS DOUBLE) / COUNT({x}))"


def exact_std(x: str) -> str:
    d = f"CAST({x} AS {DEC})"
    n = f"COUNT({x})"
    s = f"CAST(SUM({d}) AS DOUBLE)"
    ss = f"CAST(SUM({d} * {d}) AS DOUBLE)"
    return f"(CASE WHEN {n} < 2 THEN 0.0 ELSE sqrt(greatest(({ss} - {s} * {s} / {n}) / ({n} - 1), 0.0)) END)"


def lookup(key: str, table, default) -> str:
    val = lambda v: _lit(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    parts = " ".join(f"WHEN {key} = {_lit(k)} THEN {val(v)}" for k, v in table)
    d = val(default)
    return f"(CASE {parts} ELSE {d} END)"


# Common CTEs over the fixture: entries with order fields, answers with their stored position.
ENT = """ent AS (
 SELECT e.*, e.entry_id AS eid, o.o_totalprice / CAST(100 AS DOUBLE) AS judge_ms,
  strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp
 FROM e JOIN orders o ON o.o_orderkey = e.entry_id)"""
RESP = """resp AS (
 SELECT rs.*, rs.entry_id AS seq, CAST(rs.rnk - 1 AS INTEGER) AS pos FROM rs)"""
CNT = """cnt AS (
 SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE coalesce(error, '') = '') AS n_ok,
  list_reduce(list(latency_ms ORDER BY response_index), lambda a, b: a + b) AS lat
 FROM r GROUP BY entry_id)"""
LOG = """lg AS (
 SELECT ent.*, CAST(coalesce(cnt.n, 0) AS INTEGER) AS num_responses, coalesce(cnt.n_ok, 0) AS n_ok,
  ent.judge_ms + coalesce(cnt.lat, 0.0) AS total_latency_ms
 FROM ent LEFT JOIN cnt ON cnt.entry_id = ent.entry_id)"""
BASE = (ENT, RESP, CNT, LOG)


def Q(*ctes, select: str) -> str:
    return with_fixture(*BASE, *ctes, select=select)


SQL: dict[str, str] = {}

SQL["scan_log"] = Q(select=f"""
SELECT seq, CAST(entry_id AS VARCHAR) AS id, timestamp, query, strategy, confidence, final_answer,
 'Synthesized from ' || CAST(n_ok AS VARCHAR) || ' model responses using ' || coalesce(strategy, 'weighted_merge') AS reasoning,
 n_consensus, n_disagreements, total_latency_ms, num_responses
FROM lg""")

SQL["explode_responses"] = Q(select="""
SELECT e.seq, resp.pos AS response_pos, resp.model_id, resp.model_name, resp.provider, resp.content, resp.latency_ms,
 resp.error, resp.total_score, resp.rnk AS rank
FROM e LEFT JOIN resp ON resp.entry_id = e.entry_id""")

SQL["valid_responses"] = Q(select="""
SELECT seq, pos AS response_pos, model_name, total_score, rnk AS rank FROM resp
WHERE coalesce(error, '') = '' AND coalesce(content, '') <> ''""")

SQL["non_error_responses"] = Q(select="""
SELECT seq, pos AS response_pos, model_name, total_score, rnk AS rank, CAST(length(content) AS INTEGER) AS content_chars
FROM resp WHERE coalesce(error, '') = ''""")

_RECENT = """SELECT seq, CAST(entry_id AS VARCHAR) AS id, timestamp, substr(query, 1, 120) AS query,
 coalesce(confidence, 0.0) AS confidence, strategy, num_responses AS num_models FROM lg"""
SQL["recent_view"] = Q(select=_RECENT)
SQL["recent_entries"] = Q(select=f"SELECT * FROM ({_RECENT} ORDER BY seq DESC LIMIT 20) t ORDER BY seq")

SQL["result_view"] = Q(select="""
SELECT seq, pos AS response_pos, model_id, model_name, provider, content, CAST(NULL AS VARCHAR) AS reasoning_trace,
 latency_ms, error, total_score AS score, rnk AS rank, accuracy, completeness, reasoning_quality, clarity FROM resp""")

SQL["response_preview"] = Q(select="""
SELECT seq, pos AS response_pos,
 CASE WHEN coalesce(error, '') <> '' THEN 'ERROR' ELSE 'OK' END AS status,
 CASE WHEN total_score > 0 THEN 'Score: ' || printf('%.2f', total_score) ELSE '' END AS score_text,
 printf('%.0f', latency_ms) AS latency_text,
 CASE WHEN coalesce(error, '') <> '' THEN error
  ELSE substr(coalesce(content, ''), 1, 500) || CASE WHEN length(coalesce(content, '')) > 500 THEN '...' ELSE '' END END AS preview
FROM resp""")

SQL["result_summary"] = Q(select=f"""
SELECT seq, concat_ws(chr(10),
 'Query: ' || substr(query, 1, 100) || '...',
 'Strategy: ' || coalesce(strategy, 'weighted_merge'),
 'Models used: ' || CAST(num_responses AS VARCHAR),
 'Confidence: ' || {pct0('confidence')},
 'Total latency: ' || printf('%.0f', total_latency_ms) || 'ms',
 CASE WHEN n_consensus > 0 THEN 'Consensus on ' || CAST(n_consensus AS VARCHAR) || ' points' END,
 CASE WHEN n_disagreements > 0 THEN 'Disagreements on ' || CAST(n_disagreements AS VARCHAR) || ' points' END) AS summary
FROM lg""")

# --- scoring -----------------------------------------------------------------------------------

SQL["attach_scores"] = Q(select="""
SELECT entry_id AS seq, CAST(response_index AS INTEGER) AS response_index, model_name, accuracy, completeness,
 reasoning_quality, clarity, total_score FROM r""")

SQL["weighted_total"] = Q(select="SELECT seq, pos AS response_pos, total_score AS weighted_total FROM resp")

SQL["rank_responses"] = Q(select="SELECT seq, rnk AS rank, model_name, total_score, error FROM resp")

SQL["best_of_n"] = Q("""fok AS (
 SELECT seq, min(rnk) AS r1 FROM resp WHERE coalesce(error, '') = '' GROUP BY seq)""", select=f"""
SELECT e.seq, CASE WHEN fok.r1 IS NULL THEN {_lit(R.ALL_FAILED_TEXT)} ELSE resp.content END AS best_of_n
FROM e LEFT JOIN fok ON fok.seq = e.seq LEFT JOIN resp ON resp.seq = fok.seq AND resp.rnk = fok.r1""")

SQL["best_response"] = Q(select="""
SELECT e.seq, resp.model_name AS best_model, resp.total_score AS best_score
FROM e LEFT JOIN resp ON resp.seq = e.seq AND resp.rnk = 1""")

SQL["total_latency"] = Q(select="SELECT seq, total_latency_ms FROM lg")

# --- text rules ----------------------------------------------------------------------------------

SQL["classify_question"] = Q(select=f"SELECT seq, {classify('query')} AS question_type FROM e")
SQL["estimate_difficulty"] = Q(select=f"SELECT seq, {difficulty('query')} AS difficulty FROM e")
SQL["categorize_query"] = Q(select=f"SELECT seq, array_to_string({categories('query')}, ',') AS categories FROM e")

# --- routing -------------------------------------------------------------------------------------

ETYPE = f"""et AS (SELECT e.*, {classify('e.query')} AS question_type FROM e)"""
MPERF = f"""mp AS (
 SELECT et.question_type, coalesce(resp.model_name, 'unknown') AS model_name,
  {exact_avg('coalesce(resp.total_score, 0.0)')} AS avg_score, count(*) AS n,
  {exact_std('coalesce(resp.total_score, 0.0)')} AS std_score,
  min(resp.seq * 1000 + resp.pos) AS first_seen
 FROM et JOIN resp ON resp.seq = et.seq GROUP BY 1, 2)"""
SPERF = f"""sp AS (
 SELECT question_type, coalesce(strategy, 'weighted_merge') AS strategy,
  {exact_avg('coalesce(confidence, 0.0)')} AS avg_confidence, count(*) AS n, min(seq) AS first_seen
 FROM et GROUP BY 1, 2)"""
TCOUNT = """tc AS (SELECT question_type, count(*) AS n FROM et GROUP BY 1)"""
PERF = (ETYPE, MPERF, SPERF, TCOUNT)

SQL["model_perf"] = Q(*PERF, select="SELECT question_type, model_name, avg_score, n, std_score FROM mp")
SQL["strategy_perf"] = Q(*PERF, select="SELECT question_type, strategy, avg_confidence, n FROM sp")
SQL["type_counts"] = Q(*PERF, select="SELECT question_type, n, CAST(sum(n) OVER () AS BIGINT) AS total_queries FROM tc")
SQL["top_models_by_type"] = Q(*PERF, select="""
SELECT question_type, model_name,
 CAST(row_number() OVER (PARTITION BY question_type ORDER BY avg_score DESC, first_seen) AS INTEGER) AS model_rank, avg_score
FROM mp""")
SQL["best_strategy"] = Q(*PERF, select="""
SELECT question_type, strategy AS best_strategy, avg_confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY avg_confidence DESC, first_seen) AS rn FROM sp) t
WHERE rn = 1""")

_K = "CASE WHEN difficulty IN ('trivial', 'easy') THEN 2 WHEN difficulty = 'medium' THEN 3 END"
ROUTE = f"""pt AS (
 SELECT coalesce(tc.question_type, bs.question_type, mm.question_type) AS question_type, mm.models, mm.top_model, mm.top_avg,
  bs.strategy AS best_strategy, tc.n AS type_count
 FROM tc FULL JOIN (
   SELECT question_type, strategy FROM (
    SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY avg_confidence DESC, first_seen) AS rn FROM sp) t WHERE rn = 1) bs
  ON bs.question_type = tc.question_type
 FULL JOIN (
   SELECT question_type, list(model_name ORDER BY avg_score DESC, first_seen) AS models,
    arg_min(model_name, (-avg_score, first_seen)) AS top_model, max(avg_score) AS top_avg
   FROM mp GROUP BY 1) mm
  ON mm.question_type = coalesce(tc.question_type, bs.question_type)),
rq AS (
 SELECT e.seq, {classify('e.query')} AS question_type, {difficulty('e.query')} AS difficulty FROM e),
routed AS (
 SELECT rq.seq, rq.question_type, rq.difficulty,
  array_to_string(CASE WHEN pt.models IS NULL THEN [] WHEN ({_K}) IS NULL THEN pt.models ELSE pt.models[1:({_K})] END, ',') AS recommended_models,
  coalesce(pt.best_strategy, {lookup('rq.difficulty', R.STRATEGY_BY_DIFFICULTY, R.DEFAULT_STRATEGY)}) AS recommended_strategy,
  {lookup('rq.question_type', R.TEMPERATURE_BY_TYPE, R.DEFAULT_TEMPERATURE)} AS temperature,
  (rq.difficulty IN ('hard', 'expert') OR rq.question_type IN ('logical', 'mathematical', 'planning')) AS use_meta_reasoning,
  {lookup('rq.difficulty', R.DEPTH_BY_DIFFICULTY, 'standard')} AS reasoning_depth,
  least(0.95, 0.3 + CAST(coalesce(pt.type_count, 0) AS DOUBLE) / 50.0 * 0.65) AS confidence,
  concat_ws('. ', 'Question type: ' || rq.question_type, 'Difficulty: ' || rq.difficulty,
   CASE WHEN pt.models IS NOT NULL AND len(pt.models) > 0 THEN 'Best model for ' || rq.question_type || ': ' || pt.top_model || ' (' || {pct0('pt.top_avg')} || ')' END,
   CASE WHEN coalesce(pt.type_count, 0) > 0 THEN 'Based on ' || CAST(pt.type_count AS VARCHAR) || ' previous ' || rq.question_type || ' queries'
    ELSE 'No historical data — using defaults' END) AS explanation,
  pt.models, pt.top_model, pt.top_avg, pt.best_strategy, pt.type_count
 FROM rq LEFT JOIN pt ON pt.question_type = rq.question_type)"""

SQL["route"] = Q(*PERF, ROUTE, select="""
SELECT seq, question_type, difficulty, recommended_models, recommended_strategy, temperature, use_meta_reasoning,
 reasoning_depth, confidence, explanation FROM routed""")
SQL["route_temperature"] = Q(*PERF, ROUTE, select="SELECT seq, temperature FROM routed")
SQL["route_depth"] = Q(*PERF, ROUTE, select="SELECT seq, reasoning_depth FROM routed")
SQL["route_confidence"] = Q(*PERF, ROUTE, select="SELECT seq, confidence FROM routed")
SQL["use_meta_reasoning"] = Q(*PERF, ROUTE, select="SELECT seq, use_meta_reasoning FROM routed")
SQL["route_explanation"] = Q(*PERF, ROUTE, select="SELECT seq, explanation FROM routed")
SQL["perf_lookup"] = Q(*PERF, ROUTE, select="""
SELECT seq, question_type, CAST(coalesce(len(models), 0) AS INTEGER) AS n_models, top_model AS best_model, top_avg AS best_avg,
 best_strategy, coalesce(type_count, 0) AS type_count FROM routed""")

# --- collection ----------------------------------------------------------------------------------

STRIP = f"regexp_replace(coalesce(final_answer, ''), '^{WS}+|{WS}+$', '', 'g')"
ELIG = f"""(coalesce(confidence, 0.0) >= 0.6 AND num_responses >= 2 AND coalesce(final_answer, '') <> ''
 AND length({STRIP}) >= 50)"""
PAIRS = f"""tp AS (
 SELECT lg.seq, CAST(lg.entry_id AS VARCHAR) AS id, lg.query AS instruction, lg.final_answer AS output,
  lg.confidence, lg.strategy, lg.num_responses AS num_models, b.model_name AS best_model, b.total_score AS best_model_score,
  lg.n_consensus AS consensus_count, lg.n_disagreements AS disagreement_count
 FROM lg LEFT JOIN resp b ON b.seq = lg.seq AND b.rnk = 1
 WHERE {ELIG})"""

SQL["training_pair_filter"] = Q(select=f"SELECT seq FROM lg WHERE {ELIG}")
SQL["training_pairs"] = Q(PAIRS, select="SELECT * FROM tp")
SQL["training_stats"] = Q(select=f"""
SELECT count(*) AS total_queries, CAST(sum(num_responses) AS BIGINT) AS total_responses,
 count(*) FILTER (WHERE {ELIG}) AS training_pairs, {exact_avg('coalesce(confidence, 0.0)')} AS avg_confidence FROM lg""")
SQL["strategy_counts"] = Q(select="SELECT coalesce(strategy, 'weighted_merge') AS strategy, count(*) AS n FROM e GROUP BY 1")
SQL["model_counts"] = Q(select="SELECT coalesce(model_name, 'unknown') AS model_name, count(*) AS n FROM resp GROUP BY 1")
SQL["model_wins"] = Q(select="SELECT coalesce(model_name, 'unknown') AS model_name, count(*) AS wins FROM resp WHERE rnk = 1 GROUP BY 1")
SQL["training_readiness"] = Q(f"""rc AS (SELECT count(*) FILTER (WHERE {ELIG}) AS tp FROM lg)""", select=f"""
SELECT tp AS training_pairs,
 CASE WHEN tp >= 1000 THEN 'ready' WHEN tp >= 500 THEN 'almost_ready' WHEN tp >= 100 THEN 'collecting' ELSE 'early' END AS training_readiness,
 least(100.0, CAST(printf('%.1f', CAST(tp AS DOUBLE) / 1000.0 * 100.0) AS DOUBLE)) AS training_readiness_pct FROM rc""")
SQL["export_chat_log"] = Q(PAIRS, select=f"""
SELECT seq, 0 AS turn, 'system' AS role, {_lit(D.SYSTEM_TEXT)} AS content FROM tp
UNION ALL SELECT seq, 1, 'user', instruction FROM tp
UNION ALL SELECT seq, 2, 'assistant', output FROM tp""")

# --- weakness ------------------------------------------------------------------------------------

ECAT = f"""ec AS (
 SELECT lg.*, u.category, CAST(u.cat_pos AS INTEGER) AS cat_pos FROM lg,
  LATERAL (SELECT unnest({categories('lg.query')}) AS category, generate_subscripts({categories('lg.query')}, 1) - 1 AS cat_pos) u)"""
ESUM = """esum AS (
 SELECT seq, SUM(CAST(coalesce(total_score, 0.0) AS DECIMAL(18,9))) AS s FROM resp GROUP BY seq)"""
CSTATS = """cs AS (
 SELECT ec.category, count(*) AS count, count(*) FILTER (WHERE ec.n_disagreements > 0) AS disagreements,
  count(*) FILTER (WHERE coalesce(ec.confidence, 1.0) < 0.6) AS low_confidence,
  CAST(SUM(coalesce(esum.s, 0)) AS DOUBLE) AS score_sum, CAST(SUM(ec.num_responses) AS BIGINT) AS n_scores,
  min(ec.seq * 100 + ec.cat_pos) AS first_seen
 FROM ec LEFT JOIN esum ON esum.seq = ec.seq GROUP BY 1),
cs2 AS (
 SELECT category, count, disagreements, low_confidence, n_scores, first_seen,
  CASE WHEN n_scores > 0 THEN score_sum / n_scores ELSE 0.0 END AS avg_score,
  CAST(disagreements AS DOUBLE) / count AS disagreement_rate, CAST(low_confidence AS DOUBLE) / count AS low_confidence_rate
 FROM cs)"""
CMAVG = """cm AS (
 SELECT ec.category, coalesce(resp.model_name, 'unknown') AS model_name,
  CAST(SUM(CAST(coalesce(resp.total_score, 0.0) AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS avg_score, count(*) AS n,
  min(resp.seq * 1000 + resp.pos) AS first_seen
 FROM ec JOIN resp ON resp.seq = ec.seq GROUP BY 1, 2)"""
PATTERNS = f"""cf AS (SELECT * FROM cs2 WHERE count >= 2),
wm AS (
 SELECT cm.category,
  list(cm.model_name ORDER BY cm.first_seen) FILTER (WHERE cm.avg_score < cf.avg_score * 0.85) AS weak,
  list(cm.model_name ORDER BY cm.first_seen) AS every
 FROM cm JOIN cf ON cf.category = cm.category GROUP BY 1),
ex5 AS (
 SELECT category, list(query ORDER BY seq) AS examples FROM (
  SELECT category, seq, query, row_number() OVER (PARTITION BY category ORDER BY seq) AS rn FROM ec) t
 WHERE rn <= 5 GROUP BY 1),
pat AS (
 SELECT cf.*, coalesce(wm.weak, []) AS weak, wm.every, ex5.examples,
  (1.0 - cf.avg_score) * 0.4 + cf.disagreement_rate * 0.3 + cf.low_confidence_rate * 0.3 AS sev
 FROM cf LEFT JOIN wm ON wm.category = cf.category LEFT JOIN ex5 ON ex5.category = cf.category),
patk AS (
 SELECT category, least(1.0, sev) AS severity, avg_score, disagreement_rate, count, first_seen, examples,
  CASE WHEN len(weak) > 0 THEN weak ELSE coalesce(every, []) END AS affected, weak,
  concat_ws('. ', 'Models struggle with ' || replace(category, '_', ' ') || ' questions',
   '(avg score: ' || {pct0('avg_score')} || ')',
   CASE WHEN len(weak) > 0 THEN 'Weakest: ' || array_to_string(weak[1:3], ', ') END,
   CASE WHEN disagreement_rate > 0.3 THEN 'High disagreement rate (' || {pct0('disagreement_rate')} || ')' END) AS description
 FROM pat WHERE sev > 0.2 OR avg_score < 0.7)"""
WEAK = (ECAT, ESUM, CSTATS, CMAVG, PATTERNS)

SQL["category_stats"] = Q(*WEAK, select="""
SELECT category, count, disagreement_rate, low_confidence_rate, avg_score, n_scores FROM cs2""")
SQL["category_model_avg"] = Q(*WEAK, select="SELECT category, model_name, avg_score, n FROM cm")
SQL["weakness_patterns"] = Q(*WEAK, select="""
SELECT category, description, severity, array_to_string(affected, ',') AS affected_models,
 array_to_string(examples, chr(10)) AS example_queries, avg_score, disagreement_rate, count FROM patk""")
SQL["weak_models"] = Q(*WEAK, select="""
SELECT category, CAST(generate_subscripts(affected, 1) - 1 AS INTEGER) AS model_pos, unnest(affected) AS model_name FROM patk""")
SQL["severity"] = Q(*WEAK, select="SELECT category, severity FROM patk")
SQL["severity_order"] = Q(*WEAK, select="""
SELECT category, CAST(row_number() OVER (ORDER BY severity DESC, first_seen) AS INTEGER) AS position FROM patk""")
SQL["first_k_examples"] = Q(*WEAK, select="""
SELECT category, CAST(rn - 1 AS INTEGER) AS example_no, query FROM (
 SELECT category, query, row_number() OVER (PARTITION BY category ORDER BY seq) AS rn FROM ec) t WHERE rn <= 5""")
SQL["describe_weakness"] = Q(*WEAK, select="SELECT category, description FROM patk")
SQL["top_weak_models"] = Q(*WEAK, select="""
SELECT category, CAST(generate_subscripts(w3, 1) - 1 AS INTEGER) AS model_pos, unnest(w3) AS model_name
FROM (SELECT category, weak[1:3] AS w3 FROM pat WHERE len(weak) > 0) t""")

ADV = """adv AS (
 SELECT ec.seq, arg_min(ec.category, ec.cat_pos) AS weakness_category, any_value(ec.confidence) AS confidence
 FROM ec JOIN patk ON patk.category = ec.category
 WHERE coalesce(ec.confidence, 0.0) >= 0.5 AND coalesce(ec.final_answer, '') <> ''
 GROUP BY ec.seq),
failed AS (
 SELECT seq, count(*) AS n FROM resp WHERE coalesce(total_score, 0.0) < 0.5 AND coalesce(error, '') = '' GROUP BY seq)"""
SQL["adversarial_examples"] = Q(*WEAK, ADV, select="""
SELECT adv.seq, weakness_category, 1.0 - coalesce(confidence, 0.5) AS target_score_improvement,
 CAST(coalesce(failed.n, 0) AS INTEGER) AS num_failed
FROM adv LEFT JOIN failed ON failed.seq = adv.seq""")
SQL["weak_category_match"] = Q(*WEAK, ADV, select="SELECT seq, weakness_category FROM adv")
SQL["adversarial_eligible"] = Q(select="SELECT seq FROM e WHERE coalesce(confidence, 0.0) >= 0.5 AND coalesce(final_answer, '') <> ''")
SQL["failed_responses"] = Q(select="""
SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS INTEGER) AS failed_no,
 coalesce(model_name, 'unknown') AS model, coalesce(total_score, 0.0) AS score, substr(coalesce(content, ''), 1, 200) AS answer_preview
FROM resp WHERE coalesce(total_score, 0.0) < 0.5 AND coalesce(error, '') = ''""")
SQL["export_adversarial"] = Q(*WEAK, ADV, select="""
SELECT adv.seq, 1 AS turn, 'user' AS role, lg.query AS content FROM adv JOIN lg ON lg.seq = adv.seq
UNION ALL SELECT adv.seq, 2, 'assistant', lg.final_answer FROM adv JOIN lg ON lg.seq = adv.seq""")
SQL["weakness_report_entries"] = Q(*WEAK, select="""
SELECT category, CAST(printf('%.3f', severity) AS DOUBLE) AS severity, CAST(printf('%.3f', avg_score) AS DOUBLE) AS avg_score,
 CAST(printf('%.3f', disagreement_rate) AS DOUBLE) AS disagreement_rate, count AS example_count,
 array_to_string(affected, ',') AS affected_models, array_to_string(examples[1:3], chr(10)) AS sample_queries FROM patk""")
SQL["weakness_report"] = Q(*WEAK, ADV, select="""
SELECT (SELECT count(*) FROM patk) AS total_weaknesses_found, (SELECT count(*) FROM adv) AS adversarial_examples_available,
 t.category AS top_vulnerability, CAST(printf('%.3f', t.severity) AS DOUBLE) AS top_severity,
 CAST(printf('%.3f', t.avg_score) AS DOUBLE) AS top_avg_score,
 CASE WHEN t.severity IS NULL THEN 'need_data' WHEN t.severity > 0.7 THEN 'critical' WHEN t.severity > 0.4 THEN 'notable'
  ELSE 'reasonable' END AS recommendation_tier,
 CASE WHEN t.severity IS NULL THEN 'Too few logged answers to judge; collect more first.'
  WHEN t.severity > 0.7 THEN t.category || ': answers score ' || printf('%.0f', t.avg_score * 100) || '% on average, mend this category first.'
  WHEN t.severity > 0.4 THEN t.category || ': weak enough to deserve adversarial examples.'
  ELSE 'No category stands out; look at questions on which the models disagree.' END AS recommendation
FROM (SELECT 1 AS one) d LEFT JOIN (SELECT * FROM patk ORDER BY severity DESC, first_seen LIMIT 1) t ON true""")

# --- pairs -----------------------------------------------------------------------------------------

SV = """sv AS (
 SELECT seq, query, model_name, content, total_score, scores_pos,
  row_number() OVER (PARTITION BY seq ORDER BY total_score DESC, pos) AS k,
  count(*) OVER (PARTITION BY seq) AS nv
 FROM (SELECT resp.*, resp.pos AS scores_pos, e.query FROM resp JOIN e ON e.seq = resp.seq
       WHERE coalesce(error, '') = '' AND coalesce(content, '') <> '') v)"""
PREF = """bw AS (
 SELECT b.seq, b.query, b.model_name AS chosen_model, w.model_name AS rejected_model, b.total_score AS chosen_score,
  w.total_score AS rejected_score, b.content AS chosen, w.content AS rejected
 FROM sv b JOIN sv w ON w.seq = b.seq AND w.k = w.nv
 WHERE b.k = 1 AND b.nv >= 3 AND b.total_score - w.total_score >= 0.1),
adj AS (
 SELECT a.seq, a.k, a.model_name AS chosen_model, c.model_name AS rejected_model, a.total_score AS chosen_score,
  c.total_score AS rejected_score, a.content AS chosen, c.content AS rejected
 FROM sv a JOIN sv c ON c.seq = a.seq AND c.k = a.k + 1
 WHERE a.seq IN (SELECT seq FROM bw) AND a.total_score - c.total_score >= 0.05),
pp AS (
 SELECT seq, 0 AS pair_no, 'best_worst' AS pair_kind, chosen_model, rejected_model, chosen_score, rejected_score, chosen, rejected FROM bw
 UNION ALL
 SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY k) AS INTEGER), 'adjacent', chosen_model, rejected_model,
  chosen_score, rejected_score, chosen, rejected FROM adj)"""
PAIRSEL = "SELECT seq, CAST(pair_no AS INTEGER) AS pair_no, pair_kind, coalesce(chosen_model, '') AS chosen_model, coalesce(rejected_model, '') AS rejected_model, chosen_score, rejected_score, chosen, rejected FROM pp"
SQL["preference_pairs"] = Q(SV, PREF, select=PAIRSEL)
SQL["best_vs_worst"] = Q(SV, PREF, select=PAIRSEL + " WHERE pair_kind = 'best_worst'")
SQL["adjacent_pairs"] = Q(SV, PREF, select=PAIRSEL + " WHERE pair_kind = 'adjacent'")
SQL["margin"] = Q(SV, PREF, select="""
SELECT pp.seq, CAST(pair_no AS INTEGER) AS pair_no, md5('user: ' || e.query || chr(10) || 'assistant: ' || chosen) AS chosen_turns,
 md5('user: ' || e.query || chr(10) || 'assistant: ' || rejected) AS rejected_turns, chosen_score - rejected_score AS margin
FROM pp JOIN e ON e.seq = pp.seq""")
SQL["triplets"] = Q(SV, select="""
SELECT b.seq, CAST(row_number() OVER (PARTITION BY b.seq ORDER BY w.k) - 1 AS INTEGER) AS triplet_no,
 coalesce(b.model_name, '') AS good_model, coalesce(w.model_name, '') AS bad_model, b.total_score AS good_score,
 w.total_score AS bad_score, b.content AS good_answer, w.content AS bad_answer
FROM sv b JOIN sv w ON w.seq = b.seq AND w.k > 1
WHERE b.k = 1 AND b.nv >= 2 AND b.total_score - w.total_score >= 0.05""")
SQL["pseudo_quality_targets"] = Q(SV, select="""
SELECT seq, CAST(triplet_no AS INTEGER) AS triplet_no, CAST(d.dim AS INTEGER) AS dim, good_score * d.f AS target FROM (
 SELECT b.seq, row_number() OVER (PARTITION BY b.seq ORDER BY w.k) - 1 AS triplet_no, b.total_score AS good_score
 FROM sv b JOIN sv w ON w.seq = b.seq AND w.k > 1
 WHERE b.k = 1 AND b.nv >= 2 AND b.total_score - w.total_score >= 0.05) t,
 (VALUES (0, CAST(1.0 AS DOUBLE)), (1, CAST(0.9 AS DOUBLE)), (2, CAST(0.85 AS DOUBLE)), (3, CAST(0.95 AS DOUBLE))) d(dim, f)""")
SQL["debate_pairs"] = Q("""ok AS (
 SELECT seq, model_name, CAST(row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS INTEGER) AS i,
  count(*) OVER (PARTITION BY seq) AS n FROM resp WHERE coalesce(error, '') = '')""", select="""
SELECT a.seq, a.i AS debater, a.model_name, b.model_name AS other_model_name
FROM ok a JOIN ok b ON b.seq = a.seq AND b.i = (a.i + 1) % a.n WHERE a.n >= 2""")

# --- preparation -----------------------------------------------------------------------------------

SQL["quality_filter"] = Q(PAIRS, select="""
SELECT count(*) FILTER (WHERE coalesce(confidence, 0.0) >= 0.7 AND coalesce(num_models, 0) >= 3) AS loaded,
 count(*) FILTER (WHERE NOT (coalesce(confidence, 0.0) >= 0.7 AND coalesce(num_models, 0) >= 3)) AS skipped FROM tp""")
LOADED = """ld AS (SELECT * FROM tp WHERE coalesce(confidence, 0.0) >= 0.6 AND coalesce(num_models, 0) >= 2)"""
SQL["to_chatml"] = Q(PAIRS, LOADED, select=f"""
SELECT seq, 0 AS turn, 'system' AS role, {_lit(D.SYSTEM_TEXT)} AS content FROM ld
UNION ALL SELECT seq, 1, 'user', instruction FROM ld UNION ALL SELECT seq, 2, 'assistant', output FROM ld""")
SQL["to_sharegpt"] = Q(PAIRS, LOADED, select=f"""
SELECT seq, 0 AS turn, 'system' AS "from", {_lit(D.SYSTEM_TEXT)} AS value FROM ld
UNION ALL SELECT seq, 1, 'human', instruction FROM ld UNION ALL SELECT seq, 2, 'gpt', output FROM ld""")
SQL["to_alpaca"] = Q(PAIRS, LOADED, select=f"""
SELECT seq, instruction, '' AS input, output, {_lit(D.SYSTEM_TEXT)} AS system FROM ld""")
SQL["split_counts"] = Q(PAIRS, LOADED, """k AS (
 SELECT count(*) AS n, greatest(1, CAST(floor(CAST(count(*) AS DOUBLE) * 0.9) AS BIGINT)) AS k FROM ld)""", select="""
SELECT 'train' AS split, k AS n, k < 50 AS small_train_set FROM k
UNION ALL SELECT 'val', n - k, k < 50 FROM k WHERE n - k > 0""")
SQL["shuffle_split"] = Q(PAIRS, LOADED, select="""
SELECT seq, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', CAST(seq AS VARCHAR)))) <= greatest(1, CAST(floor(CAST(count(*) OVER () AS DOUBLE) * 0.9) AS BIGINT))
 THEN 'train' ELSE 'val' END AS split FROM ld""")
SQL["dataset_summary"] = Q(PAIRS, LOADED, select=f"""
SELECT count(*) AS n_pairs, CAST(sum(length(instruction)) AS DOUBLE) / count(*) AS avg_instruction_chars,
 CAST(sum(length(output)) AS DOUBLE) / count(*) AS avg_output_chars, {exact_avg('confidence')} AS avg_confidence FROM ld""")
SQL["best_model_distribution"] = Q(PAIRS, LOADED, select="""
SELECT coalesce(best_model, 'unknown') AS best_model, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM ld GROUP BY 1""")

# --- catalog -----------------------------------------------------------------------------------------

CATALOG = """cat AS (
 SELECT CAST(row_number() OVER (ORDER BY first_seen) AS INTEGER) AS config_order, provider, model_id, model_name,
  provider IN ('prov_0', 'prov_1') AS enabled,
  CASE model_id WHEN 'm0' THEN 'reasoning' WHEN 'm1' THEN 'fast' WHEN 'm2' THEN 'deep_reasoning' WHEN 'm3' THEN 'reasoning'
   WHEN 'm4' THEN 'fast' END AS role
 FROM (SELECT provider, model_id, model_name, min(seq * 1000 + pos) AS first_seen FROM resp GROUP BY 1, 2, 3) t),
act AS (
 SELECT config_order, provider, model_id, model_name, coalesce(role, 'reasoning') AS role FROM cat
 WHERE enabled AND provider IN ('prov_0', 'prov_1'))"""
SQL["model_catalog"] = Q(CATALOG, select="SELECT * FROM act")
SQL["filter_by_role"] = Q(CATALOG, select="SELECT * FROM act WHERE role IN ('reasoning', 'deep_reasoning')")
SQL["platform_status"] = Q(CATALOG, select="""
SELECT (SELECT array_to_string(list(provider ORDER BY mo), ',') FROM (SELECT provider, min(config_order) AS mo FROM act GROUP BY 1) p)
  AS active_providers, count(*) AS active_models, 'weighted_merge' AS synthesis_strategy FROM act""")
SQL["select_judge"] = Q(CATALOG, select="""
SELECT CASE WHEN max(CAST(provider = 'prov_2' AS INT)) = 1 THEN 'prov_2' ELSE arg_min(provider, config_order) END AS judge_provider,
 CASE WHEN max(CAST(provider = 'prov_2' AS INT)) = 1 THEN 'm2' ELSE arg_min(model_id, config_order) END AS judge_model
FROM act HAVING count(*) > 0""")
SQL["request_defaults"] = Q(select=f"""
SELECT seq, coalesce(strategy, 'weighted_merge') AS strategy, {_lit(D.SYSTEM_TEXT)} AS system_prompt FROM e""")
SQL["validate_request"] = Q("""br AS (
 SELECT seq, min(pos) AS p FROM resp WHERE model_id NOT IN ('m0', 'm1', 'm2', 'm3', 'm4') GROUP BY seq)""", select="""
SELECT e.seq, br.seq IS NULL AS valid, CASE WHEN br.seq IS NOT NULL THEN 'Invalid role: unknown' END AS reject_reason
FROM e LEFT JOIN br ON br.seq = e.seq""")
SQL["fan_out"] = Q("""m(model_pos, model_id, provider, role) AS (VALUES
 (0, 'm0', 'prov_0', 'reasoning'), (1, 'm1', 'prov_1', 'fast'), (2, 'm3', 'prov_0', 'reasoning'), (3, 'm4', 'prov_1', 'fast'))""",
                   select="SELECT e.seq, CAST(m.model_pos AS INTEGER) AS model_pos, m.model_id, m.provider, m.role FROM e, m")
SQL["catalog_lookup"] = Q(CATALOG, select="""
SELECT resp.model_id, resp.seq, resp.pos AS response_pos, cat.provider AS catalog_provider, cat.role AS catalog_role
FROM resp LEFT JOIN cat ON cat.model_id = resp.model_id""")
SQL["request_params"] = Q(select="""
SELECT seq, pos AS response_pos,
 CASE WHEN starts_with(model_id, 'o1') OR starts_with(model_id, 'o3') OR contains(model_id, 'opus') THEN NULL ELSE CAST(0.7 AS DOUBLE) END AS temperature,
 CASE WHEN starts_with(model_id, 'o1') OR starts_with(model_id, 'o3') THEN NULL ELSE 4096 END AS max_tokens,
 CASE WHEN starts_with(model_id, 'o1') OR starts_with(model_id, 'o3') THEN 4096 END AS max_completion_tokens,
 CASE WHEN contains(model_id, 'opus') THEN 10000 END AS thinking_budget_tokens
FROM resp""")
SQL["difficulty_steps"] = Q(f"""dl AS (SELECT seq, {difficulty('query')} AS d FROM e)""", select="""
SELECT seq, CAST(list_position(['trivial', 'easy', 'medium', 'hard', 'expert'], d) - 1 AS INTEGER) AS level,
 CAST(greatest(2, list_position(['trivial', 'easy', 'medium', 'hard', 'expert'], d) + 1) AS INTEGER) AS steps FROM dl""")

# --- embedding space ---------------------------------------------------------------------------------------

def _triples(vector: str = "embedding") -> str:
    return f"""slots AS (
 SELECT vec_id // 3 AS triple,
  any_value({vector}) FILTER (WHERE vec_id % 3 = 0) AS r0,
  any_value({vector}) FILTER (WHERE vec_id % 3 = 1) AS r1,
  any_value({vector}) FILTER (WHERE vec_id % 3 = 2) AS r2
 FROM embeddings GROUP BY 1),
tri AS (SELECT triple, coalesce(r0, r1, r2) AS zp, coalesce(r1, r0, r2) AS zt, coalesce(r2, r1, r0) AS zn FROM slots)"""


TRIPLES = _triples()
# The same vectors far from zero, where differences of large sums would lose the spread.
SHIFTED = _triples("list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1e6)")


def _dsum(expr: str) -> str:
    return f"list_reduce(list_prepend(0.0, {expr}), lambda a, b: a + b)"


def _dot(a: str, b: str) -> str:
    return _dsum(f"list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))")


def _norm(a: str) -> str:
    return f"sqrt({_dsum(f'list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))')})"


def _dist(a: str, b: str) -> str:
    d = f"list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE) + 1e-6)"
    return f"sqrt({_dsum(f'list_transform({d}, lambda v: v * v)')})"


COS = f"{_dot('zp', 'zt')} / (greatest({_norm('zp')}, 1e-8) * greatest({_norm('zt')}, 1e-8))"
SQL["cosine_similarity"] = with_fixture(TRIPLES, select=f"SELECT triple, {COS} AS cosine FROM tri")
INV = """sq AS (SELECT unnest(list_transform(list_zip(zp, zt), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS v FROM tri)"""
SQL["invariance_loss"] = with_fixture(TRIPLES, INV, select="SELECT avg(v) AS invariance FROM sq")
VAR = """dims AS (
 SELECT 'p' AS side, CAST(generate_subscripts(zp, 1) AS INTEGER) AS dim, CAST(unnest(zp) AS DOUBLE) AS v FROM tri
 UNION ALL SELECT 't', CAST(generate_subscripts(zt, 1) AS INTEGER), CAST(unnest(zt) AS DOUBLE) FROM tri),
vl AS (SELECT side, {avg} AS v FROM (SELECT side, dim, {std} AS s FROM dims GROUP BY 1, 2) t GROUP BY 1)""".format(
    avg="avg(greatest(0.0, 1.0 - s))", std="coalesce(stddev_samp(v), 0.0)")
SQL["variance_loss"] = with_fixture(TRIPLES, VAR, select="SELECT sum(v) AS variance FROM vl")
COV = """cv AS (
 SELECT a.side, a.dim AS i, b.dim AS j, covar_samp(a.v, b.v) AS c
 FROM (SELECT side, triple, dim, v FROM (
   SELECT 'p' AS side, triple, CAST(generate_subscripts(zp, 1) AS INTEGER) AS dim, CAST(unnest(zp) AS DOUBLE) AS v FROM tri
   UNION ALL SELECT 't', triple, CAST(generate_subscripts(zt, 1) AS INTEGER), CAST(unnest(zt) AS DOUBLE) FROM tri) x) a
 JOIN (SELECT side, triple, dim, v FROM (
   SELECT 'p' AS side, triple, CAST(generate_subscripts(zp, 1) AS INTEGER) AS dim, CAST(unnest(zp) AS DOUBLE) AS v FROM tri
   UNION ALL SELECT 't', triple, CAST(generate_subscripts(zt, 1) AS INTEGER), CAST(unnest(zt) AS DOUBLE) FROM tri) y) b
  ON a.side = b.side AND a.triple = b.triple AND a.dim <> b.dim
 GROUP BY 1, 2, 3),
cl AS (SELECT side, avg(c * c) AS v FROM cv GROUP BY 1)"""
SQL["covariance_loss"] = with_fixture(TRIPLES, COV, select="SELECT sum(v) AS covariance FROM cl")
SQL["covariance_loss_shifted"] = with_fixture(SHIFTED, COV, select="SELECT sum(v) AS covariance FROM cl")
SQL["variance_loss_shifted"] = with_fixture(SHIFTED, VAR, select="SELECT sum(v) AS variance FROM vl")
CON = f"""pr AS (SELECT triple, {_dist('zp', 'zt')} AS pos_dist, {_dist('zp', 'zn')} AS neg_dist FROM tri)"""
SQL["contrastive_loss"] = with_fixture(TRIPLES, CON, select="SELECT avg(greatest(0.0, pos_dist - neg_dist + 1.0)) AS contrastive FROM pr")
SQL["collapse_report"] = with_fixture(TRIPLES, INV, VAR, COV, CON, """lo AS (
 SELECT (SELECT {inv} FROM sq) AS invariance, (SELECT sum(v) FROM vl) AS variance, (SELECT sum(v) FROM cl) AS covariance,
  (SELECT {con} FROM pr) AS contrastive)""".format(inv="avg(v)", con="avg(greatest(0.0, pos_dist - neg_dist + 1.0))"),
    select="SELECT invariance, variance, covariance, contrastive, invariance * 25.0 + variance * 25.0 + covariance * 1.0 + contrastive * 10.0 AS total FROM lo")
SQL["mean_pool"] = with_fixture("""tok AS (
 SELECT label, CAST(CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS m, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""", select="""
SELECT label, dim, sum(m * x) / greatest(sum(m), 1.0) AS value FROM tok GROUP BY 1, 2""")
SQL["rerank"] = with_fixture(TRIPLES, f"""cand AS (
 SELECT triple, 0 AS idx, {COS} AS score FROM tri
 UNION ALL SELECT triple, 1, {COS.replace('zt', 'zn')} FROM tri)""", select="""
SELECT triple, CAST(idx AS INTEGER) AS idx, score, CAST(row_number() OVER (PARTITION BY triple ORDER BY score DESC, idx) AS INTEGER) AS rank FROM cand""")


def oracle_sql() -> dict[str, str]:
    from chorus.plans import extra_oracles  # noqa: F401  (adds the remaining statements)
    return dict(SQL)
