"""Text rules: question type, difficulty, categories (App. A), whitespace (T6), substring rules
(T7), regex and JSON (T8), critique folds (T10), percent formatting (T5)."""

from pyspark.sql import functions as F

from chorus.functions import text as TX
from chorus.sources.fixtures import TEMPLATES

# Expected labels of the fixture templates (FIXTURES.md section 3).
EXPECTED = [
    ("coding", "easy", "coding"),
    ("mathematical", "easy", "mathematical"),
    ("factual", "trivial", "coding,factual_recall"),
    ("comparison", "easy", "multi_step"),
    ("explanation", "easy", "general"),
    ("creative", "easy", "creative"),
    ("ethical", "easy", "ethical_nuanced"),
    ("mathematical", "expert", "mathematical,multi_step"),
    ("logical", "easy", "logical_reasoning"),
    ("general", "easy", "general"),
    ("mathematical", "trivial", "mathematical,factual_recall"),
    ("general", "trivial", "ambiguous"),
    ("logical", "medium", "logical_reasoning,ambiguous"),
    ("factual", "easy", "factual_recall"),
    ("planning", "hard", "multi_step"),
]


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_template_labels(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEMPLATES)], "tid int, q string")
    rows = df.select("tid", TX.classify_question("q").alias("t"), TX.estimate_difficulty("q").alias("d"),
                     F.array_join(TX.categorize_query("q"), ",").alias("c")).orderBy("tid").collect()
    assert [(r.t, r.d, r.c) for r in rows] == EXPECTED


def test_substring_not_word(spark):
    # T7: "api" hits "capital", "if" hits "different", "vs" any word with those letters
    assert _one(spark, TX.categorize_query, "The capital city")[0] == "coding"
    assert _one(spark, TX.classify_question, "How different are they") == "logical"
    assert _one(spark, TX.classify_question, "canvs painting") == "comparison"


def test_python_whitespace(spark):
    # Python strip / split are Unicode-aware; Spark trim is not
    assert _one(spark, TX.py_strip, "\t　 hello  \n") == "hello"
    assert _one(spark, TX.py_word_count, "  a b\tc\n") == 3
    assert _one(spark, TX.py_word_count, "") == 0
    assert _one(spark, TX.py_word_count, "\x1c one \x1f two") == 2


def test_dot_matches_carriage_return(spark):
    # Python's '.' crosses '\r' but not '\n'
    assert "logical_reasoning" in _one(spark, TX.categorize_query, "if it rains\rthen")
    assert "logical_reasoning" not in _one(spark, TX.categorize_query, "if it rains\nthen")


def test_question_marks_and_compare(spark):
    # hard: compare+and, more than one '?' (2); easy: fewer than 15 words (1) -> 1 -> medium
    assert _one(spark, TX.estimate_difficulty, "Compare A and B? Why? How?") == "medium"
    # hard 2, easy 2 -> 0, and two easy signals -> trivial
    assert _one(spark, TX.estimate_difficulty, "What is X? Compare it and Y? Define it") == "trivial"


def test_percent_half_even(spark):
    # T5: Python rounds the exact binary value half to even
    vals = [0.125, 0.175, 0.445, 0.5, 0.995, 0.0, 1.0]
    got = [_one(spark, lambda c: TX.percent0(c.cast("double")), str(v)) for v in vals]
    assert got == [f"{v:.0%}" for v in vals]
    fixed = [spark.createDataFrame([(v,)], "v double").select(TX.py_fixed(F.col("v"), 2)).first()[0]
             for v in (0.125, 0.175, 0.285, 0.295, 1234.565)]
    assert fixed == [f"{v:.2f}" for v in (0.125, 0.175, 0.285, 0.295, 1234.565)]


JUDGE = '{"scores": [{"model_index": 0, "accuracy": 0.9}], "confidence": 0.8}'


def test_judge_json_fallbacks(spark):
    texts = [
        JUDGE,
        "text\n```json\n" + JUDGE + "\n```\nmore",
        "```\n" + JUDGE + "\n```",
        "prose " + JUDGE + " prose",
        "no json here",
        "[1, 2, 3]",
        '{"scores": [{"model_index": 0.0, "accuracy": "0.9"}]}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", TX.judge_fields(TX.extract_judge_json("t")).alias("j")).orderBy("i").collect()
    for r in rows[:4]:
        assert r.j.confidence == 0.8 and r.j.scores[0].accuracy == 0.9
    assert rows[4].j.confidence == 0.5 and rows[4].j.scores is None and rows[4].j.consensus_points == []
    assert rows[5].j.confidence == 0.5 and rows[5].j.scores is None            # non-object JSON: no scores
    assert rows[6].j.scores[0].model_index == 0.0 and rows[6].j.scores[0].accuracy is None   # string score -> NULL


def test_critique_fold(spark):
    cases = {
        "No major issues found.": (0.85, ["No major issues found."]),           # T10: counts as an issue
        "Confidence: 40\nno significant issues": (0.85, []),
        "no significant issues\nConfidence: 40": (0.4, []),
        "Confidence 120": (1.2, []),                                             # not capped
        " Critical: bad \r\nconfidence 7 and 9": (0.07, ["Critical: bad"]),
        "nothing": (0.7, []),
    }
    for text, (conf, issues) in cases.items():
        r = _one(spark, TX.parse_critique, text)
        assert abs(r.confidence - conf) < 1e-12 and r.issues == issues, text
    assert _one(spark, TX.parse_verification, "Confidence 90\nconfidence: 95") == 0.95
    assert _one(spark, TX.parse_verification, "Confidence: 150") == 1.0
    assert _one(spark, TX.parse_verification, "none") == 0.7
