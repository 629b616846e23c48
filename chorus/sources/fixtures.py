"""Stand-in input built from the driver's tables (see FIXTURES.md).

This module only produces rows in the shapes the jobs expect: raw answers of several models per
question and the judge's parsed reply. It does none of the jobs' work: weighted totals, ranks,
the raw record itself and every analysis are computed by the library from these rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.operators import scoring
from chorus.sources.tables import read_table

# Question templates of FIXTURES.md section 3 (fixed values of the fixture).
TEMPLATES = [
    "Implement a python routine that merges two sorted lists",
    "Prove that the sum of two even integers is even",
    "What is the capital of Peru?",
    "Compare row stores and column stores, list pros and cons and a trade-off",
    "Explain how tides form",
    "Write a poem on rain",
    "Should cities ban cars? Is it fair? Give an opinion",
    "Outline, step by step, how to plan, prove and optimize a data architecture, then compare batch and stream layouts. Which one wins? Why?",
    "Is this claim a paradox: nobody deduces what everybody implies",
    "Tell me something nice today",
    "What is the probability of two sixes",
    "Define entropy",
    "If it rains then the road is wet; it could be wet anyway, so what do you say follows from a wet road in a town where it has not rained for a whole week and nobody has washed any street, roof, car, yard, path, wall or fence since the last dry day of the long past winter?",
    "Who was first to reach the south pole and when did that happen",
    "Outline step by step a plan to move house this coming week? What do we pack first, and what do we pack last of all?",
]
N_TEMPLATES = len(TEMPLATES)
CREATIVE_TID = 5
TURNS = 8          # turns that an entry may take its question from; other turns than the user's leave the bare template


# Tables with at most so many rows, and texts of so many bytes in all, meet the log by a broadcast join; larger ones by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
REF = "\u0001"     # a reference to a document's text: this mark, its doc_id and its copy number


def _ref(doc, copy):
    """The reference of a text from the copy number of its document (``_marks``): null for a null text or an unknown
    document, '' for an empty text."""
    return F.when(copy == 0, F.lit("")).when(copy > 0, F.concat(F.lit(REF), doc.cast("string"), F.lit(":"), copy.cast("string")))


def _documents(spark: SparkSession, sf_dir: str):
    """doc_id, text and copy (1, 2, ... by text among documents of the same doc_id) of all documents, and their facts:
    n_keys (keys 0..max), rows, copies (most of a doc_id), bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    each = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    facts = each.agg((F.max("doc_id") + 1).alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                     F.coalesce(F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("copies"),
                     F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) if facts.copies > 1 else F.lit(1)
    return docs.where("doc_id is not null").withColumn("copy", copy.cast("int")), facts


def _is_small(rows: int, n_bytes: int = 0) -> bool:
    return rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES


def _small(table: DataFrame, rows: int, n_bytes: int = 0) -> DataFrame:
    return F.broadcast(table) if _is_small(rows, n_bytes) else table


def _marks(docs: DataFrame, facts) -> DataFrame:
    """For each document its doc_id and copy number; 0 for an empty text, null for a null one."""
    marks = docs.select(F.col("doc_id").alias("m_doc"), F.when(F.col("text") == "", F.lit(0)).when(F.col("text").isNotNull(), F.col("copy")).alias("copy"))
    return _small(marks, facts.rows)


def with_texts(spark: SparkSession, sf_dir: str, df: DataFrame, *cols: str) -> DataFrame:
    """``df`` (with ``seq``) with the whole texts in place of the references in ``cols``; other values stay."""
    docs, facts = _documents(spark, sf_dir)
    texts = docs.where("text != ''").select(_ref(F.col("doc_id"), F.col("copy")).alias("ref"), F.col("text").alias("ref_text"))
    out = df
    for c in cols:
        is_ref = F.col(c).startswith(REF)
        # values that refer to nothing are spread over the partitions
        key = F.when(is_ref, F.col(c)).otherwise(F.concat(F.lit("-"), F.col("seq").cast("string")))
        out = out.withColumn("_key", key).join(_small(texts, facts.rows, facts.bytes), F.col("_key") == F.col("ref"), "left")
        out = out.withColumn(c, F.when(is_ref, F.col("ref_text")).otherwise(F.col(c))).select(*df.columns)
    return out


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str):
    """Number of keys 0..max of a table, as a scalar subquery inside the plan."""
    return read_table(spark, sf_dir, table).agg(F.max(key) + 1).scalar()


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the user turns by (conv_id, turn), line breaks as blanks."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    size = c.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    turns = c.groupBy(F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn")).agg(
        F.min(F.translate("text", "\r\n", "  ")).alias("u_text"))
    return _small(turns, size.rows, size.bytes)


def _questions(spark: SparkSession, sf_dir: str, docs: DataFrame, facts) -> DataFrame:
    """The given columns that a question is made from, and the copy number of its answer's document."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")
    doc = F.col("o_orderkey") % F.lit(facts.n_keys)
    return o.join(_marks(docs, facts), doc == F.col("m_doc"), "left").select(*o.columns, F.col("copy").alias("o_copy"))


def _entry_fields(facts) -> list:
    """Entry grain (FIXTURES ``e``): one question per order, from the columns of ``_questions``; the final answer as a reference."""
    k = F.col("o_orderkey")
    tid = (k % N_TEMPLATES).cast("int")
    conf_num = F.when(tid == CREATIVE_TID, 800 + (k * 7919) % 201).otherwise((k * 7919) % 1001)
    prio = F.substring("o_orderpriority", 1, 1)
    return [
        k.alias("entry_id"),
        F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), tid + 1).alias("ask"),
        F.when(prio == "1", "best_of_n").when(prio == "2", "weighted_merge")
        .when(prio == "3", "debate").when(prio == "4", "chain_of_verification").alias("strategy"),
        (conf_num.cast("double") / F.lit(1000.0)).alias("confidence"),
        F.when((F.col("o_orderstatus") == "P") & (tid != CREATIVE_TID), 1).otherwise(0).alias("n_disagreements"),
        (k % 4).cast("int").alias("n_consensus"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        (F.col("o_totalprice") / F.lit(100.0)).alias("judge_ms"),
        F.when(k % 11 == 0, "").when(k % 11 == 1, "Too short.").otherwise(_ref(k % F.lit(facts.n_keys), F.col("o_copy"))).alias("final_answer"),
    ]


DIMS = ["accuracy", "completeness", "reasoning_quality", "clarity"]
# What an answer is made from, in the order of a question's answers.
ANSWER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
TASK_ANSWERS = 200_000     # answers that one task collects by question, on average; they are several times wider there than in the shuffle
TASK_BYTES = 64 << 20      # texts that one task puts into its answers, on average
NO_COPY = 15               # stands for no copy number in a packed answer


def _packed(a: DataFrame) -> DataFrame:
    """``_answers`` by reference as entry_id and two numbers that hold all other columns bit by bit, for the shuffle. An answer with a
    column that has no room there (null, negative, zero or large, a price not in cents, a day with a time) keeps all of them in
    ``rest``; ``_unpacked`` gives the same rows back."""
    kinds = dict(a.dtypes)
    n, part, supp, q, x, d = (F.col(c) for c in ANSWER)
    qty = F.when((q > 0) & (q < 1 << 12), q.cast("long"))
    cents = F.when((x > 0) & (x < 1 << 24), F.rint(x * 100).cast("long"))
    day = F.unix_date(d.cast("date")).cast("long")
    # copies by two, a failed answer (whose copy is 0) as 1
    code = F.coalesce(F.when(F.col("failed"), F.lit(1)).otherwise(F.col("said").cast("long") * 2), F.lit(NO_COPY))
    fits = (n.between(0, (1 << 8) - 1) & part.between(0, (1 << 31) - 1) & supp.between(0, (1 << 24) - 1) & (qty.cast(kinds["l_quantity"]) == q)
            & ((cents / 100).cast(kinds["l_extendedprice"]) == x) & day.between(0, (1 << 16) - 1)
            & (F.date_from_unix_date(day.cast("int")).cast(kinds["l_shipdate"]) == d) & ((code < NO_COPY) | F.col("said").isNull()))
    bits = lambda *parts: F.when(F.col("_fits"), reduce(Column.bitwiseOR, [F.shiftleft(c.cast("long"), k) for c, k in parts]))
    # bytes that vary stand together and before those that seldom do (high bytes of entry_id, rest): the shuffle then compresses better
    return a.withColumn("_fits", F.coalesce(fits, F.lit(False))).select(
        bits((part, 32), (supp, 8), (n, 0)).alias("who"), bits((cents, 32), (day, 16), (qty, 4), (code, 0)).alias("what"), "entry_id",
        F.when(~F.col("_fits"), F.struct(*ANSWER, "said", "failed")).alias("rest"))


def _unpacked(p: DataFrame, kinds: dict) -> DataFrame:
    """The rows that ``_packed`` was given, whose column types are ``kinds``."""
    part = lambda c, k, width: F.shiftright(c, k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    code = part("what", 0, 4)
    held = {
        "l_linenumber": part("who", 0, 8), "l_partkey": part("who", 32, 31), "l_suppkey": part("who", 8, 24), "l_quantity": part("what", 4, 12),
        "l_extendedprice": part("what", 32, 31) / 100, "l_shipdate": F.date_from_unix_date(part("what", 16, 16).cast("int")),
        "said": F.when(code != NO_COPY, F.shiftright(code, 1)), "failed": F.when(code == 1, F.lit(True)),
    }
    return p.select("entry_id", *[F.when(F.col("rest").isNull(), v.cast(kinds[c])).otherwise(F.col(f"rest.{c}")).alias(c) for c, v in held.items()])


def _by_entry(spark: SparkSession, a: DataFrame, rows: int, n_bytes: int = 0) -> DataFrame:
    """Answers by reference moved by entry, packed, to so many partitions that a task's share, of answers and of the ``n_bytes`` of text
    that they get there, does not grow with the table (partitions of a size in the shuffle would hold too many of them)."""
    cores = spark.sparkContext.defaultParallelism
    n = 1 + max(rows // TASK_ANSWERS, min(cores, rows // (TASK_ANSWERS // 10)), n_bytes // TASK_BYTES)
    return _unpacked(_packed(a).repartition(n, "entry_id"), dict(a.dtypes))


def _answers(spark: SparkSession, sf_dir: str, docs: DataFrame, facts, refs: bool) -> DataFrame:
    """Response grain (FIXTURES ``r``): the given columns that an answer is made from, whether it failed, and its text, or with
    ``refs`` the copy number of its document. Other fields are derived after the shuffle (``_judged``, ``_response``)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", *ANSWER, "l_returnflag")
    failed = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit(True))
    doc = F.col("l_partkey") % F.lit(facts.n_keys)
    # the texts of a small table meet the answers where these have moved to; those of a large one move with them
    late = not refs and _is_small(facts.rows, facts.bytes)
    given = _marks(docs, facts) if refs or late else docs.select(F.col("doc_id").alias("m_doc"), "text")
    said = F.when(failed, F.lit(0)).otherwise(F.col("copy")) if refs or late else F.when(failed, F.lit("")).otherwise(F.col("text"))
    r = li.join(given, doc == F.col("m_doc"), "left")
    r = r.select(F.col("l_orderkey").alias("entry_id"), *ANSWER, said.alias("said"), failed.alias("failed"))
    if not (refs or late):
        return r
    # without texts, whole rows are narrow: they move once, unsorted
    rows = li.count()
    r = _by_entry(spark, r, rows, rows * (facts.bytes // max(facts.rows, 1)) if late else 0)
    if refs:
        return r
    texts = F.broadcast(docs.where("text != ''").select(F.col("doc_id").alias("t_doc"), F.col("copy").alias("t_copy"), "text"))
    r = r.join(texts, (doc == F.col("t_doc")) & (F.col("said") == F.col("t_copy")), "left")
    return r.select("entry_id", *ANSWER, F.when(F.col("said") == 0, F.lit("")).otherwise(F.col("text")).alias("said"), "failed")


def _judged(a: DataFrame) -> DataFrame:
    """``_answers`` with the judge's four scores."""
    raw = {
        "accuracy": (F.col("l_partkey") * 31 + F.col("l_linenumber") * 7) % 101,
        "completeness": (F.col("l_partkey") * 17 + F.col("l_suppkey") * 3) % 101,
        "reasoning_quality": (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 101,
        "clarity": (F.col("l_partkey") * 5 + F.col("entry_id") * 11) % 101,
    }
    m, tid = F.col("l_suppkey") % 6, F.col("entry_id") % N_TEMPLATES

    def dim(v):
        pct = F.when(F.col("failed"), F.lit(0)).when(tid == CREATIVE_TID, 88 + v % 13).otherwise(F.floor(v * (10 - m) / 10))
        return pct.cast("double") / F.lit(100.0)

    return a.withColumns({n: dim(v) for n, v in raw.items()})


def _response(x, facts, refs: bool):
    """The raw answer of an element of ``_answers``."""
    m = x["l_suppkey"] % 6
    return F.struct(
        F.concat(F.lit("m"), m.cast("string")).alias("model_id"), F.concat(F.lit("model_"), m.cast("string")).alias("model_name"),
        F.concat(F.lit("prov_"), (m % 3).cast("string")).alias("provider"),
        (_ref(x["l_partkey"] % F.lit(facts.n_keys), x["said"]) if refs else x["said"]).alias("content"),
        F.lit(None).cast("string").alias("reasoning_trace"), (x["l_extendedprice"] / F.lit(10.0)).alias("latency_ms"),
        F.when(x["failed"], F.lit("Timed out after 120s")).alias("error"))


def raw_entries(spark: SparkSession, sf_dir: str, refs: bool = False) -> DataFrame:
    """Questions with their raw answers (original order) and the judge's parsed reply, nested per
    question the way a collector receives them. One shuffle, by entry.

    With ``refs`` the answers' contents and the final answer are references in place of texts, null and empty ones stay as
    they are; ``with_texts`` puts the texts of those that are needed in their place."""
    docs, facts = _documents(spark, sf_dir)
    a = _judged(_answers(spark, sf_dir, docs, facts, refs))
    grouped = a.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct(*ANSWER, "said", "failed", *DIMS))).alias("_rows"))
    grouped = grouped.withColumnRenamed("entry_id", "r_entry")
    q = _questions(spark, sf_dir, docs, facts)
    j = q.join(grouped, F.col("o_orderkey") == F.col("r_entry"), "left")
    j = j.select(*_entry_fields(facts), "_rows")
    # texts come last, so that no shuffle by entry carries them
    conv = _keys(spark, sf_dir, "conversations", "conv_id")
    turns = _user_turns(spark, sf_dir)
    j = j.withColumns({"_conv": F.col("entry_id") % conv, "_turn": F.floor(F.col("entry_id") / conv) % TURNS})
    j = j.join(turns, (F.col("_conv") == F.col("u_conv")) & (F.col("_turn") == F.col("u_turn")), "left")
    j = j.withColumn("query", F.concat_ws(" ", "u_text", "ask"))
    points = lambda n, word: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.format_string(word + " %d", i))
    rows = F.coalesce("_rows", F.array().cast(grouped.schema["_rows"].dataType))
    out = j.select(
        F.col("entry_id").alias("seq"),
        F.col("entry_id").cast("string").alias("id"),
        "timestamp", "query", "strategy", "final_answer", "judge_ms",
        F.transform(rows, lambda x: _response(x, facts, refs)).alias("responses"),
        F.struct(
            F.transform(rows, lambda x, i: F.struct(i.cast("double").alias("model_index"), *[x[n].alias(n) for n in DIMS])).alias("scores"),
            F.slice(points(F.col("n_consensus"), "consensus point"), 1, F.col("n_consensus")).alias("consensus_points"),
            F.slice(points(F.col("n_disagreements"), "disagreement point"), 1, F.col("n_disagreements")).alias("disagreement_points"),
            F.col("confidence").alias("confidence"),
        ).alias("judge"),
    )
    return out if refs else with_texts(spark, sf_dir, out, "final_answer")


def ensemble_log(spark: SparkSession, sf_dir: str, refs: bool = False) -> DataFrame:
    """The raw ensemble log (D7 + seq): stand-in answers scored, ranked and recorded by the library; ``refs`` as in ``raw_entries``."""
    return scoring.to_raw_record(scoring.score_entries(raw_entries(spark, sf_dir, refs)))


def reviewed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn with a critique and a verification (FIXTURES ``rv``): its whole text,
    followed by lines that its length decides."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    sure = lambda every, lead, top: F.when(every, F.concat(F.lit("\n" + lead), (n % top).cast("string")))
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.concat_ws("", t, F.when(n % 3 == 0, F.concat(F.lit("\n  Major gap after: "), F.substring_index(t, "\n", 1))),
                    sure(n % 5 < 3, "Confidence: ", 131), F.when(n % 7 == 0, F.lit("\nNo major issues found."))).alias("critique"),
        F.concat_ws("", t, sure(n % 5 < 3, "Confidence ", 121), sure(n % 4 == 0, "Final confidence: ", 97)).alias("verification"))
