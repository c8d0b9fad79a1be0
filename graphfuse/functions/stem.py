"""English stemming (Porter 1980), applied to the distinct words of a corpus only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import STOP_WORDS



def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    form = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", form))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


#: Suffix, replacement, for steps 2 to 4 of the published algorithm.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _replace(w: str, table: str, least: int) -> str:
    for pair in sorted(table.split(), key=lambda p: -len(p.partition(":")[0])):
        suffix, _, to = pair.partition(":")
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + to if _measure(base) > least else w
    return w


def porter(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4.split(), key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


def lexemes(words: list[str]) -> list[str | None]:
    """Stem of each word; None for stop words."""
    stop = set(STOP_WORDS)
    return [None if w in stop else porter(w) for w in words]


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, lexeme) of the distinct tokens; stop words drop out."""

    @F.pandas_udf("string")
    def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(lexemes(s.tolist()), dtype=object)

    return tokens.select("token").distinct().withColumn("lexeme", stem("token")).filter("lexeme is not null")
