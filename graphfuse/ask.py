"""Grounded answers: prompt under a token budget, numbered citations."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .providers import Provider
from .schema import DEFAULT_BUDGET, InvalidConfig

SYSTEM = "Answer from the numbered passages alone. Cite each passage you use by its number in square brackets. If they don't hold the answer, say so."
NOTHING = "Nothing in the corpus matches the question."


@dataclass
class Prompt:
    system: str
    text: str
    kept: list[int]
    dropped: int


def budget_fold(rows: str | Column, budget: int | Column) -> Column:
    """Greedy choice under a budget, over an array of structs (…, tokens) in order.

    A row that doesn't fit is skipped, not the end; skipped rows don't count.
    Returns the array of kept positions, from 1.
    """
    rows = F.col(rows) if isinstance(rows, str) else rows
    most = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))
    numbered = F.transform(rows, lambda r, i: F.struct(r["tokens"].cast("bigint").alias("t"), (i + 1).alias("i")))
    step = lambda acc, r: F.when(
        acc["used"] + r["t"] <= most,
        F.struct((acc["used"] + r["t"]).alias("used"), F.concat(acc["kept"], F.array(r["i"])).alias("kept")),
    ).otherwise(acc)
    return F.aggregate(numbered, start, step, lambda acc: acc["kept"])


def build_prompt(question: str, passages: list[tuple[str, int]], budget: int = DEFAULT_BUDGET) -> Prompt:
    """A prompt of the passages (text, tokens) that fit, numbered from 1; ids never enter it."""
    if budget <= 0:
        raise InvalidConfig("the token budget is positive")
    if not passages:
        raise InvalidConfig("there are no passages")
    if passages[0][1] > budget:
        raise InvalidConfig("the first passage alone is over the token budget")
    kept, used = [], 0
    for i, (_, n) in enumerate(passages):
        if used + n <= budget:
            kept.append(i)
            used += n
    blocks = "\n\n".join(f"[{k}] {passages[i][0]}" for k, i in enumerate(kept, 1))
    return Prompt(SYSTEM, f"Passages:\n{blocks}\n\nQuestion: {question}\n\nAnswer:", kept, len(passages) - len(kept))


def extract_citations(answer: str, n: int) -> list[int]:
    """Numbers cited, 1 to n, each once, by first appearance."""
    found = (int(k) for k in re.findall(r"\[(\d{1,9})\]", answer))
    return list(dict.fromkeys(k for k in found if 1 <= k <= n))


def answer(question: str, hits: list[dict], provider: Provider, budget: int = DEFAULT_BUDGET) -> dict:
    """Answer a question from retrieved rows (chunk_id, document_id, text, token_count, signals)."""
    if not hits:
        return {"answer": NOTHING, "citations": [], "signals": {"retrieval": {"chunks_in_prompt": 0, "dropped_for_budget": 0}}, "mode_used": "hybrid"}
    p = build_prompt(question, [(h["text"], h["token_count"]) for h in hits], budget)
    began = time.monotonic()
    got = provider.complete(p.system, p.text)
    cited = [{"n": k, "chunk_id": hits[p.kept[k - 1]]["chunk_id"], "document_id": hits[p.kept[k - 1]]["document_id"]} for k in extract_citations(got.text, len(p.kept))]
    return {
        "answer": got.text,
        "citations": cited,
        "signals": {
            "retrieval": {"chunks_in_prompt": len(p.kept), "dropped_for_budget": p.dropped},
            "llm": {"provider": provider.name, "model": got.model, "latency_ms": int(1000 * (time.monotonic() - began)), "prompt_tokens": got.prompt_tokens, "completion_tokens": got.completion_tokens},
        },
        "mode_used": "hybrid",
    }
