"""Reviews and traces of conversation turns."""

from pyspark.sql import functions as F

from chorus.operators import traces as TR
from chorus.sources import fixtures as FX
from tests.conftest import SF_SMALL


def test_reviews_read_whole_texts_and_set_every_mark(spark):
    turns = FX.reviewed_turns(spark, SF_SMALL)
    assert turns.where(~F.col("critique").startswith(F.coalesce("text", F.lit("")))).isEmpty()
    got = TR.parsed(turns).select("critique_confidence", "verification_confidence", F.size("issues").alias("n"), "needs_refinement").collect()
    assert {r.n for r in got} >= {0, 1} and {r.needs_refinement for r in got} == {True, False}
    assert len({r.critique_confidence for r in got}) > 20
    assert max(r.verification_confidence for r in got) <= 1.0 < max(r.critique_confidence for r in got)


def test_rollup_takes_latest_steps_without_a_sort_aggregate(spark, capsys):
    rows = [(1, 0, "decompose", "plan", None), (1, 1, "reason", "first", None), (1, 2, "verify", "v", 0.5), (1, 5, "refine", "second", None),
            (1, 6, "verify", "w", None), (2, 0, "decompose", "only", None), (3, 9, "verify", "late", 0.9), (3, 3, "reason", None, None)]
    steps = spark.createDataFrame(rows, "query_id long, step_no int, stage string, output_text string, confidence double")
    rolled = TR.trace_rollup(steps)
    got = {r.query_id: (r.final_answer, r.overall_confidence, r.num_refinements) for r in rolled.collect()}
    assert got == {1: ("second", None, 1), 2: (None, None, 0), 3: (None, 0.9, 0)}
    rolled.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    assert TR.trace_rollup(steps.limit(0)).isEmpty()


def test_steps_of_a_conversation(spark):
    turns = spark.createDataFrame([(7, 0, "user", "ask", "c", "v"), (7, 1, "assistant", "one", "c", "Confidence 90"),
                                   (7, 2, "user", "why", "Major flaw\nConfidence: 40", "v"), (7, 3, "assistant", "two", "c", "v"),
                                   (7, 4, "user", "again", "Critical gap\nConfidence: 30", "v")],
                                  "conv_id long, turn long, role string, text string, critique string, verification string")
    got = [(r.step_no, r.stage, r.confidence, r.issues_found) for r in TR.conversation_steps(turns).orderBy("step_no").collect()]
    assert got == [(0, "decompose", None, []), (2, "reason", None, []), (3, "verify", 0.9, []), (4, "decompose", None, []),
                   (6, "refine", None, []), (7, "verify", 0.7, []), (8, "critique", 0.3, ["Critical gap"])]
