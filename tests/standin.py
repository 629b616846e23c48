"""A model function for the dispatch tests: answers decided by its arguments."""

from __future__ import annotations

import hashlib
import json


def _h32(text: str) -> int:
    """First 32 bits of the MD5 of a text (a stable pseudo-random number)."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16)


def standin_generate(model_id: str, prompt: str, system_prompt, temperature: float, max_tokens: int):
    """Deterministic answers: judge prompts get a JSON reply scoring every answer block; other
    prompts get a short text. One call in 23 fails for model m5 (an error row)."""
    h = _h32(model_id + "|" + prompt)
    if model_id == "m5" and h % 23 == 0:
        raise RuntimeError("model unavailable")
    if "Reply in JSON" in prompt:
        n = prompt.count("\n--- Model ")
        scores = []
        for i in range(n):
            k = _h32(f"{prompt}|{i}")
            scores.append({"model_index": i, "accuracy": (k % 101) / 100, "completeness": ((k >> 8) % 101) / 100,
                           "reasoning_quality": ((k >> 16) % 101) / 100, "clarity": ((k >> 24) % 101) / 100})
        return json.dumps({"scores": scores, "consensus_points": ["shared point"], "disagreement_points": [],
                           "confidence": (h % 100) / 100}), None
    if prompt.startswith("Critique: "):
        return ("Major issue: a step is unclear.\nConfidence: 70" if h % 2 else "No major issues found.\nConfidence: 90"), None
    if prompt.startswith("Verify: "):
        return f"Confidence: {80 + h % 20}", None
    return f"[{model_id}] answer {h % 997} to: {prompt[:60]}", None
