import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chorus import schemas as S  # noqa: E402
from chorus.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="chorus-tests")
    yield s


def resp(model="m", score=0.5, content="answer text", error=None, rank=None, scores=None, provider="p"):
    return {"model_id": model, "model_name": model, "provider": provider, "content": content, "reasoning_trace": None,
            "latency_ms": 10.0, "error": error, "scores": scores if scores is not None else {}, "total_score": score,
            "rank": rank}


def entry(seq, query="q", responses=(), confidence=0.7, strategy="weighted_merge", final_answer="x" * 60,
          consensus=(), disagreements=(), latency=0.0):
    rs = []
    for i, r in enumerate(responses):
        r = dict(r)
        if r["rank"] is None:
            r["rank"] = i + 1
        rs.append(r)
    return {"seq": seq, "id": str(seq), "timestamp": "2026-01-01T00:00:00", "query": query, "strategy": strategy,
            "confidence": confidence, "final_answer": final_answer, "reasoning": "", "consensus_points": list(consensus),
            "disagreement_points": list(disagreements), "total_latency_ms": latency, "responses": rs}


@pytest.fixture
def make_log(spark):
    def _make(entries):
        return spark.createDataFrame(entries, S.RAW_LOG)
    return _make
