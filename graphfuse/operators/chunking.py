"""Chunking strategies: (document_id, text) to (document_id, ord, text, token_count)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..schema import InvalidConfig

MAX_CHARS, MIN_CHARS, SECTION_CHARS = 2000, 200, 100
WINDOW, STEP = 300, 150
STRATEGIES = ("auto", "sentence_aware", "hierarchy", "fixed_overlap", "neighbor_expand", "semantic")

_HEADING = re.compile(r"(?m)^#{1,6}[ \t].*$")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?]+[\"')\]]*\s*|[^.!?\n]+\n?|\n")


def strategy(name: str | None) -> str:
    """A known strategy; anything else, and a missing one, is ``auto``.  Case counts."""
    return name if name in STRATEGIES else "auto"


def _sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of each part of a marked-up text; the first may lack a heading."""
    at = [(m.start(), m.end()) for m in _HEADING.finditer(text)]
    if not at:
        return [("", text)]
    out = [("", text[: at[0][0]])] if text[: at[0][0]].strip() else []
    for (s, e), nxt in zip(at, [a for a, _ in at[1:]] + [len(text)], strict=True):
        out.append((text[s:e].strip(), text[e:nxt]))
    return out


def _pack(text: str, most: int, least: int) -> list[str]:
    """Sentences run together up to ``most`` characters; a short last one joins its neighbour."""
    out: list[str] = []
    held = ""
    for s in _SENTENCE.findall(text):
        while len(s) > most:
            cut = s.rfind(" ", 1, most) if " " in s[1:most] else most
            if held.strip():
                out.append(held.strip())
                held = ""
            out.append(s[:cut].strip())
            s = s[cut:]
        if len(held) + len(s) > most and held.strip():
            out.append(held.strip())
            held = ""
        held += s
    if held.strip():
        if out and len(held.strip()) < least and len(out[-1]) + 1 + len(held.strip()) <= most:
            out[-1] += "\n" + held.strip()
        else:
            out.append(held.strip())
    return [c for c in out if c]


def sentence_aware(text: str) -> list[str]:
    """Paragraphs and sentences packed up to MAX_CHARS; headed sections stay apart."""
    out = []
    for heading, body in _sections(text):
        parts = _pack(body, MAX_CHARS - len(heading) - 1 if heading else MAX_CHARS, MIN_CHARS)
        if heading:
            parts = [f"{heading}\n{parts[0]}", *parts[1:]] if parts else [heading]
        out += parts
    return out


def hierarchy(text: str) -> list[str]:
    """One chunk a headed section, the heading in front; sections of under 100 characters drop."""
    out = []
    for heading, body in _sections(text):
        whole = f"{heading}\n{body.strip()}".strip()
        if len(whole) < SECTION_CHARS:
            continue
        room = MAX_CHARS - len(heading) - 1
        out += [f"{heading}\n{p}".strip() for p in _pack(body, max(room, MIN_CHARS), 0)]
    return out


def _by_python(docs: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(d, k, c) for d, t in zip(pdf["document_id"], pdf["text"], strict=True) for k, c in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "ord", "text"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInPandas(run, f"document_id {kind}, ord int, text string")


def fixed_overlap(docs: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Windows of ``window`` words at every multiple of ``step`` below the word count."""
    words = docs.select("document_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("words"))
    words = words.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))
    return words.select("document_id", "words", F.posexplode(starts).alias("ord", "at")).select(
        "document_id", "ord", F.array_join(F.slice("words", F.col("at") + 1, F.lit(window)), " ").alias("text")
    )


def neighbor_expand(chunks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Each chunk with its neighbours before and after, cut at ``most`` characters."""
    w = W.partitionBy("document_id").orderBy("ord")
    whole = F.concat_ws("\n", F.lag("text").over(w), F.col("text"), F.lead("text").over(w))
    return chunks.select("document_id", "ord", F.substring(whole, 1, most).alias("text"))


def chunk(docs: DataFrame, name: str | None = "auto") -> DataFrame:
    """Chunks of every document under a strategy; empty documents have none."""
    how = strategy(name)
    if how == "semantic":
        raise InvalidConfig("the semantic strategy needs a sentence model, which this engine has none of")
    if how == "fixed_overlap":
        out = fixed_overlap(docs)
    elif how == "hierarchy":
        out = _by_python(docs, hierarchy)
    else:
        out = _by_python(docs, sentence_aware)
        if how == "neighbor_expand":
            out = neighbor_expand(out)
    return out.withColumn("token_count", token_count("text"))


def chunk_errors(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, error) of documents that no chunk came from."""
    none = docs.join(chunks.select("document_id").distinct(), "document_id", "left_anti")
    return none.select("document_id", F.lit("no chunks").alias("error"))
