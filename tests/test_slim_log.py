"""The log with references in place of texts: same rows as the whole log, and no text in the shuffle by question."""

import datetime

import pytest
from pyspark.sql import functions as F

from chorus.operators import logview as LV
from chorus.operators import router_store as RS
from chorus.operators import scoring as SC
from chorus.plans import extra_more as EM
from chorus.plans import registry
from chorus.sources import fixtures as FX
from chorus.sources import io as IO

# Queries whose shuffle by question must not carry texts.
SLIM = [
    "attach_scores",
    "best_of_n",
    "platform_status",
    "quality_filter",
    "recent_entries",
    "recent_view",
    "select_judge",
    "severity_order",
    "stats_snapshot",
    "explode_responses",
    "extract_judge_json",
    "failed_responses",
    "filter_by_role",
    "judge_fields",
    "margin",
    "model_catalog",
    "model_wins",
    "non_error_responses",
    "training_readiness",
    "training_stats",
    "triplets",
    "perf_lookup",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few questions over documents with null, empty, repeated and missing ids."""
    at = str(tmp_path_factory.mktemp("slim"))
    day = datetime.datetime(2024, 5, 6)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    docs = [(0, "text of zero, " * 9), (1, None), (2, ""), (3, "b" * 300), (3, "a" * 70), (3, "a" * 70), (5, "five " * 30), (7, "seven " * 50), (None, "lost")]
    put("documents", docs, "doc_id long, text string")
    put("conversations", [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}\nof {c}") for c in range(5) for t in range(4)], "conv_id long, turn int, role string, text string")
    put("orders", [(k, "P" if k % 3 == 0 else "F", None if k % 13 == 0 else f"{k % 5 + 1}-X", 100.0 + k, day) for k in range(60)],
        "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate timestamp")
    li = [(k, (k * 7 + n * 3) % 23 if n != 3 else None, (k + n) % 9, n, float(n), 1000.0 + k * n, "R" if (k + n) % 4 == 0 else "N", day) for k in range(55) for n in range(1, 2 + k % 5)]
    li += li[:6] + [(10, 3, 1, 1, 1.0, 50.0, flag, day) for flag in ("N", "R", None)]
    put("lineitem", li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp")
    return at


def _flat(log):
    ex = LV.explode_responses(log, keep=("seq", "final_answer", "query", "total_latency_ms"))
    return ex.withColumn("scores", F.to_json("scores"))


@pytest.mark.parametrize("rows", [FX.BROADCAST_ROWS, 0])
def test_texts_by_reference_equal_the_whole_log(spark, tables, monkeypatch, rows):
    monkeypatch.setattr(FX, "BROADCAST_ROWS", rows)
    key = lambda r: tuple("" if v is None else f"+{v}" for v in r)
    whole = sorted(map(tuple, _flat(FX.ensemble_log(spark, tables)).collect()), key=key)
    slim = sorted(map(tuple, FX.with_texts(spark, tables, _flat(FX.ensemble_log(spark, tables, refs=True)), "content", "final_answer").collect()), key=key)
    assert whole == slim
    # an unknown document leaves one row, one of three copies three
    texts = spark.read.parquet(f"{tables}/documents.parquet").groupBy("doc_id").count()
    n = spark.read.parquet(f"{tables}/lineitem.parquet").join(texts, F.col("l_partkey") % 8 == F.col("doc_id"), "left").agg(F.sum(F.coalesce("count", F.lit(1)))).first()[0]
    answers = FX.raw_entries(spark, tables, refs=True).dropDuplicates(["seq"]).agg(F.sum(F.size("responses"))).first()[0]
    assert answers == n


@pytest.mark.parametrize("name", SLIM)
def test_no_text_in_the_shuffle_by_question(spark, tables, name, monkeypatch):
    monkeypatch.setattr(FX, "BROADCAST_ROWS", 0)
    kept = []       # a stored table is looked at before it is written
    monkeypatch.setattr(IO, "write_stats", lambda df, path: kept.append(df))
    monkeypatch.setattr(IO, "read_stats", lambda spark, path: kept[0])
    df = registry.queries()[name](spark, tables)
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list(" in x and ("l_linenumber" in x or "_order" in x)]
    assert lines and not any("content" in x or "text" in x for x in lines)


ANSWER_ROWS = [
    # fits; then each column null, out of range or not exactly held
    (1, 3, 50, 7, 12.0, 1234.56, datetime.datetime(2024, 5, 6), 1, None), (1, 1, 50, 7, 12.0, 1234.56, datetime.datetime(2024, 5, 6), 0, True),
    (2, 1, 0, 0, 1.0, 0.07, datetime.datetime(1970, 1, 1), 0, None), (2, 255, 2**31 - 1, 2**24 - 1, 4095.0, 16777215.99, datetime.datetime(2149, 6, 6), 7, None),
    (3, 1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), None, None), (3, None, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (3, 1, None, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None), (3, 1, 5, None, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (3, 1, 5, 6, None, 8.0, datetime.datetime(2024, 1, 1), 1, None), (3, 1, 5, 6, 7.0, None, datetime.datetime(2024, 1, 1), 1, None),
    (3, 1, 5, 6, 7.0, 8.0, None, 1, None), (None, 1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None), (4, 256, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (4, -1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None), (4, 1, 2**31, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (4, 1, -5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None), (4, 1, 5, 2**24, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (4, 1, 5, -6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 1, None), (5, 1, 5, 6, 7.5, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (5, 1, 5, 6, 4096.0, 8.0, datetime.datetime(2024, 1, 1), 1, None), (5, 1, 5, 6, -0.0, 8.0, datetime.datetime(2024, 1, 1), 1, None),
    (5, 1, 5, 6, float("nan"), float("inf"), datetime.datetime(2024, 1, 1), 1, None), (5, 1, 5, 6, 1e300, -1e300, datetime.datetime(2024, 1, 1), 1, None),
    (6, 1, 5, 6, 7.0, 8.001, datetime.datetime(2024, 1, 1), 1, None), (6, 1, 5, 6, 7.0, -0.0, datetime.datetime(2024, 1, 1), 1, None),
    (6, 1, 5, 6, 7.0, float("nan"), datetime.datetime(2024, 1, 1), 1, None), (6, 1, 5, 6, 7.0, 2.0**24, datetime.datetime(2024, 1, 1), 1, None),
    (7, 1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1, 0, 0, 1), 1, None), (7, 1, 5, 6, 7.0, 8.0, datetime.datetime(1969, 12, 31), 1, None),
    (7, 1, 5, 6, 7.0, 8.0, datetime.datetime(2149, 6, 7), 1, None), (7, 1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 8, None),
    (7, 1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 2**31 - 1, None), (2**62, 1, 5, 6, 7.0, 8.0, datetime.datetime(2024, 1, 1), 7, None),
]


@pytest.mark.parametrize("when", ["timestamp", "timestamp_ntz"])
def test_packed_answers_come_back_as_they_were(spark, when):
    a = spark.createDataFrame(ANSWER_ROWS, f"entry_id long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate {when}, said int, failed boolean")
    packed = FX._packed(a)
    back = FX._unpacked(packed, dict(a.dtypes))
    assert back.dtypes == a.dtypes
    # repr tells -0.0 from 0.0 and shows NaN
    assert sorted(map(repr, back.collect())) == sorted(map(repr, a.collect()))
    assert packed.where("rest is null").count() == 7


# Queries of round 3 whose log moved in wide rows, in partitions by size.
@pytest.mark.parametrize("name", ["select_judge", "filter_by_role", "judge_fields", "model_catalog"])
def test_answers_move_packed_in_bounded_shares(spark, tables, name, monkeypatch):
    monkeypatch.setattr(FX, "TASK_ANSWERS", 10)
    rows = spark.read.parquet(f"{tables}/lineitem.parquet").count()
    assert rows > 100
    df = registry.queries()[name](spark, tables)
    plan = df._jdf.queryExecution().optimizedPlan()
    moved = [x for x in str(plan.toString()).splitlines() if "RepartitionByExpression [entry_id" in x]
    assert moved and all(int(x.rsplit(", ", 1)[1]) > rows // 10 for x in moved)
    at = [i for i, x in enumerate(plan.toString().splitlines()) if "RepartitionByExpression [entry_id" in x]
    below = [plan.toString().splitlines()[i + 1] for i in at]
    assert all("AS who" in x and "AS what" in x and "AS rest" in x for x in below)
    # the questions meet the answers where they are: these do not move again
    whole = df._jdf.queryExecution().executedPlan().toString()
    assert whole.count("hashpartitioning(entry_id") == len(moved) and "hashpartitioning(r_entry" not in whole


def test_packed_bytes_that_vary_stand_together(spark):
    """The two numbers come first, then the question, then what is nearly always null: LZ4 finds one run of equal bytes a row."""
    a = spark.createDataFrame(ANSWER_ROWS, "entry_id long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp, said int, failed boolean")
    assert FX._packed(a).columns == ["who", "what", "entry_id", "rest"]


# Queries of round 3 that write the whole log, F7 and F14.
@pytest.mark.parametrize("name", ["refresh_router_perf", "file_size_mb"])
def test_texts_of_a_small_table_do_not_move_with_the_whole_log(spark, tables, name, monkeypatch):
    monkeypatch.setattr(FX, "TASK_BYTES", 1000)
    logs = []
    build = FX.ensemble_log
    monkeypatch.setattr(FX, "ensemble_log", lambda *a, **k: logs.append(build(*a, **k)) or logs[-1])
    registry.queries()[name](spark, tables).collect()
    assert len(logs) == 1 and logs[0].columns[-1] == "responses"
    moved = [x for x in logs[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression [entry_id" in x]
    # shares follow the bytes of text: more than 100 answers of 80 bytes and more
    assert len(moved) == 1 and int(moved[0].rsplit(", ", 1)[1]) > 8
    # the answers move once, without texts, and these are broadcast: nothing is dealt by question after that
    plan = logs[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(entry_id") == 1 and "hashpartitioning(r_entry" not in plan
    at = plan[plan.index("hashpartitioning(entry_id"):].splitlines()
    assert "who" in at[1] and "what" in at[1] and "text" not in at[1]


def test_whole_log_has_the_same_rows_however_its_texts_move(spark, tables, monkeypatch):
    # maps cannot be compared, their JSON can
    rows = lambda: sorted(FX.ensemble_log(spark, tables).select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
    late = rows()
    monkeypatch.setattr(FX, "BROADCAST_BYTES", 0)
    assert late == rows() and any("text of zero" in x for x in late)


def test_stored_log_of_the_router_holds_whole_texts_compressed(spark, tables, monkeypatch):
    seen = []
    refresh = RS.refresh
    monkeypatch.setattr(RS, "refresh", lambda spark, path, store: seen.append(path) or refresh(spark, path, store))
    got = registry.queries()["refresh_router_perf"](spark, tables).collect()
    assert got and len(seen) == 2
    read = lambda df: sorted(df.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
    assert read(IO.scan_log_parquet(spark, seen[0])) == read(FX.ensemble_log(spark, tables))
    assert all(f.endswith(".zstd.parquet") for f in RS._listing(spark, seen[0]) if f.startswith("part"))


# Queries of round 4 that score the answers of a question once: F8-F10, F12, F14, F16, F18-F23, F26-F28, F30-F33, F35-F37 (those that store
# what they read again stand by the operator that they share).
SCORED_ONCE = ["best_model_distribution", "catalog_lookup", "dataset_summary", "export_chat_log", "model_counts", "model_perf", "quality_filter", "rank_responses",
               "request_params", "result_view", "shuffle_split", "split_counts", "to_alpaca", "to_chatml", "to_sharegpt", "top_models_by_type",
               "training_pair_filter", "training_pairs", "weighted_total"]


@pytest.mark.parametrize("name", SCORED_ONCE)
def test_no_filter_scores_the_answers_again(spark, tables, name):
    plan = registry.queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # only the ranking sorts a transformed array; what is evaluated more than once stands in the plan more than once
    ranking = [x for x in plan if "sort_array(transform(" in x]
    assert ranking and not any("Filter (" in x or x.count("sort_array(transform(") > 1 for x in ranking)


def test_a_filter_on_the_ranked_answers_keeps_its_rows(spark, tables):
    scored = SC.score_entries(FX.raw_entries(spark, tables, refs=True)).select("seq", "ranked")
    rows = {r.seq: [(x.rank, x.total_score) for x in r.ranked] for r in scored.collect()}
    assert any(len(v) > 4 for v in rows.values()) and all([k for k, _ in v] == [*range(1, len(v) + 1)] and [s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in rows.values())
    kept = {r.seq for r in scored.where(F.size("ranked.rank") >= 3).collect()}
    assert kept == {k for k, v in rows.items() if len(v) >= 3}


# Queries of round 4 whose answers stand in rows of their own, F15 and F11.
@pytest.mark.parametrize("name", ["response_preview", "normalize_payload"])
def test_previews_and_payloads_fetch_texts_last(spark, tables, name, monkeypatch):
    rows = lambda: sorted(registry.queries()[name](spark, tables).select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
    small = rows()
    monkeypatch.setattr(FX, "BROADCAST_ROWS", 0)
    assert small == rows() and any("text of zero" in x for x in small)
    plan = registry.queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    gathered = [x for x in plan if "collect_list(" in x and "l_linenumber" in x]
    assert gathered and not any("text" in x for x in gathered)


# The streams of round 4, F4, F5 and F24.
def test_folder_of_the_streams_holds_the_whole_log_compressed(spark, tables, monkeypatch):
    monkeypatch.setattr(FX, "TASK_BYTES", 1000)
    path = EM._log_folder(spark, tables)
    files = [f for f in RS._listing(spark, path) if f.startswith("part")]
    # a file of each task that has rows: the log is not moved into four
    assert len(files) > 4 and all(f.endswith(".json.gz") for f in files)
    key = lambda df: sorted(df.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
    assert key(IO.scan_log(spark, path)) == key(FX.ensemble_log(spark, tables))


# Queries of round 4 that pair the valid answers, F2 and F29.
@pytest.mark.parametrize("name", ["best_vs_worst", "triplets"])
def test_valid_answers_are_found_once_per_question(spark, tables, name):
    plan = registry.queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    found = [x.count("filter(arrays_zip(") for x in plan if "filter(arrays_zip(" in x]
    assert found == [1]
