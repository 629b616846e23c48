"""Oracle SQL for the queries registered in ``extra_more``."""

from __future__ import annotations

from chorus.plans.oracles import (LOADED, PAIRS, PERF, ROUTE, SQL, TRIPLES, Q, _dist, _dsum,
                                  with_fixture)

SQL["stream_training_pairs"] = SQL["training_pairs"]
SQL["scan_training_pairs"] = SQL["training_pairs"]
SQL["write_train_val"] = Q(PAIRS, LOADED, """k AS (
 SELECT count(*) AS n, greatest(1, CAST(floor(CAST(count(*) AS DOUBLE) * 0.9) AS BIGINT)) AS k FROM ld)""", select="""
SELECT 'train' AS split, k AS n, k < 50 AS small_train_set FROM k
UNION ALL SELECT 'val', n - k, k < 50 FROM k WHERE n - k > 0""")
SQL["write_reward_set"] = SQL["margin"]

_STATS = f"""st AS (
 SELECT 'total' AS kind, 'queries' AS key, count(*) AS n, CAST(SUM(CAST(coalesce(confidence, 0.0) AS DECIMAL(38,18))) AS DOUBLE) AS conf_sum FROM lg
 UNION ALL SELECT 'total', 'responses', CAST(sum(num_responses) AS BIGINT), 0.0 FROM lg
 UNION ALL SELECT 'total', 'training_pairs', (SELECT count(*) FROM tp), 0.0
 UNION ALL SELECT 'strategy', coalesce(strategy, 'weighted_merge'), count(*), 0.0 FROM lg GROUP BY 2
 UNION ALL SELECT 'model', coalesce(model_name, 'unknown'), count(*), 0.0 FROM resp GROUP BY 2
 UNION ALL SELECT 'win', coalesce(model_name, 'unknown'), count(*), 0.0 FROM resp WHERE rnk = 1 GROUP BY 2)"""
SQL["stream_stats"] = Q(PAIRS, _STATS, select="SELECT kind, key, CAST(n AS BIGINT) AS n, conf_sum FROM st")
SQL["stats_snapshot"] = Q(PAIRS, _STATS, select="SELECT kind, key, CAST(n AS BIGINT) AS n FROM st")

SQL["write_router_perf"] = Q(*PERF, ROUTE, select="""
SELECT question_type, best_strategy, type_count, CAST(len(models) AS INTEGER) AS n_models, top_model AS best_model FROM pt""")

_SQ = _dsum("list_transform(list_zip(zp, zt), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))")
_BATCH = f"""bl AS (
 SELECT ep.epoch, CAST((tri.triple * 7 + ep.epoch * 3) % 8 AS INTEGER) AS batch,
  {_SQ} AS sq, len(zp) AS d, greatest(0.0, {_dist('zp', 'zt')} - {_dist('zp', 'zn')} + 1.0) AS m
 FROM tri, (SELECT unnest(range(0, 3)) AS epoch) ep),
bg AS (
 SELECT epoch, batch, CAST(SUM(CAST(sq AS DECIMAL(38,18))) AS DOUBLE) / SUM(d) AS invariance,
  CAST(SUM(CAST(m AS DECIMAL(38,18))) AS DOUBLE) / count(*) AS contrastive
 FROM bl GROUP BY 1, 2),
bt AS (SELECT *, invariance * 25.0 + contrastive * 10.0 AS total FROM bg),
em AS (
 SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS n_batches, CAST(sum(CAST(invariance AS DECIMAL(38,18))) AS DOUBLE) / count(invariance) AS invariance,
  CAST(sum(CAST(contrastive AS DECIMAL(38,18))) AS DOUBLE) / count(contrastive) AS contrastive, CAST(sum(CAST(total AS DECIMAL(38,18))) AS DOUBLE) / count(total) AS total FROM bt GROUP BY 1)"""
SQL["epoch_means"] = with_fixture(TRIPLES, _BATCH, select="SELECT * FROM em")
SQL["best_epoch"] = with_fixture(TRIPLES, _BATCH, select="""
SELECT epoch AS best_epoch, total AS best_loss FROM em ORDER BY total, epoch LIMIT 1""")

SQL["to_raw_record"] = SQL["scan_log"]
SQL["scan_prepared"] = SQL["write_train_val"]
SQL["read_stats"] = SQL["stats_snapshot"]
SQL["stream_log_source"] = Q(select="""
SELECT seq, CAST(entry_id AS VARCHAR) AS id, query, strategy, confidence, num_responses FROM lg""")
from chorus.operators import judge as _JD  # noqa: E402
from chorus.plans.oracles import _lit  # noqa: E402

_SCORE_BLOCKS = """sb AS (
 SELECT entry_id, string_agg(CASE WHEN coalesce(error, '') <> ''
   THEN chr(10) || '--- Model ' || CAST(response_index AS VARCHAR) || ' (' || model_name || ', ' || provider || ') [ERROR: ' || error || '] ---' || chr(10)
   ELSE chr(10) || '--- Model ' || CAST(response_index AS VARCHAR) || ' (' || model_name || ', ' || provider || ') ---' || chr(10) || coalesce(content, '') || chr(10) END,
   '' ORDER BY response_index) AS blocks
 FROM r GROUP BY entry_id)"""
SQL["build_score_prompt"] = Q(_SCORE_BLOCKS, select=f"""
SELECT e.seq, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5, CAST(len(string_split(p, chr(10) || '--- Model ')) - 1 AS INTEGER) AS n_blocks
FROM (SELECT e.seq, replace(replace({_lit(_JD.SCORE_TEMPLATE)}, '{{{{QUERY}}}}', e.query), '{{{{RESPONSES}}}}', coalesce(sb.blocks, '')) AS p
      FROM e LEFT JOIN sb ON sb.entry_id = e.entry_id) e""")

_MERGE_BLOCKS = """mb AS (
 SELECT seq, string_agg(chr(10) || '--- ' || model_name || ' (' || provider || ') [Score: ' || printf('%.2f', total_score)
   || ', Rank: ' || CAST(rnk AS VARCHAR) || '] ---' || chr(10) || coalesce(content, '') || chr(10), '' ORDER BY rnk) AS blocks
 FROM resp WHERE coalesce(error, '') = '' GROUP BY seq),
pts AS (
 SELECT seq,
  CASE WHEN n_consensus > 0 THEN array_to_string(list_transform(range(1, n_consensus + 1), lambda i: '- consensus point ' || CAST(i AS VARCHAR)), chr(10)) ELSE 'None identified' END AS cons,
  CASE WHEN n_disagreements > 0 THEN array_to_string(list_transform(range(1, n_disagreements + 1), lambda i: '- disagreement point ' || CAST(i AS VARCHAR)), chr(10)) ELSE 'None identified' END AS dis
 FROM e)"""
SQL["build_merge_prompt"] = Q(_MERGE_BLOCKS, select=f"""
SELECT seq, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5, contains(p, 'None identified') AS has_none_identified FROM (
 SELECT e.seq, replace(replace(replace(replace({_lit(_JD.MERGE_TEMPLATE)}, '{{{{QUERY}}}}', e.query), '{{{{RANKED_RESPONSES}}}}', coalesce(mb.blocks, '')),
   '{{{{CONSENSUS}}}}', pts.cons), '{{{{DISAGREEMENTS}}}}', pts.dis) AS p
 FROM e LEFT JOIN mb ON mb.seq = e.seq JOIN pts ON pts.seq = e.seq) t""")

SQL["build_debate_prompt"] = Q("""ok AS (
 SELECT seq, model_name, content, CAST(row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS INTEGER) AS i,
  count(*) OVER (PARTITION BY seq) AS n FROM resp WHERE coalesce(error, '') = '')""", select=f"""
SELECT seq, debater, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5 FROM (SELECT a.seq, a.i AS debater,
 replace(replace(replace({_lit(_JD.DEBATE_TEMPLATE)}, '{{{{MODEL_NAME}}}}', coalesce(a.model_name, '')),
   '{{{{YOUR_RESPONSE}}}}', coalesce(a.content, '')), '{{{{OTHER_RESPONSE}}}}', coalesce(b.content, '')) AS p
FROM ok a JOIN ok b ON b.seq = a.seq AND b.i = (a.i + 1) % a.n WHERE a.n >= 2)""")
SQL["build_verify_prompt"] = Q(select=f"""
SELECT seq, CAST(length(p) AS INTEGER) AS prompt_chars, md5(p) AS prompt_md5
FROM (SELECT seq, replace(replace({_lit(_JD.VERIFY_TEMPLATE)}, '{{{{QUERY}}}}', query), '{{{{ANSWER}}}}', coalesce(final_answer, '')) AS p FROM lg)""")
SQL["short_id"] = Q("""h AS (SELECT seq, sha256(query || timestamp) AS h FROM lg),
c8 AS (SELECT substr(h, 1, 8) AS p FROM h GROUP BY 1 HAVING min(h) <> max(h)),
c12 AS (SELECT substr(h, 1, 12) AS p FROM h GROUP BY 1 HAVING min(h) <> max(h))""", select="""
SELECT seq, substr(h, 1, CASE WHEN substr(h, 1, 8) NOT IN (SELECT p FROM c8) THEN 8 WHEN substr(h, 1, 12) NOT IN (SELECT p FROM c12) THEN 12 ELSE 16 END) AS short_id FROM h""")
SQL["nearest_answers"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.z, b.z), 6) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS INTEGER) AS rank FROM s)
SELECT id, rank, other, score FROM k WHERE rank <= 10"""
SQL["refresh_router_perf"] = SQL["write_router_perf"]
