"""JSON functions: containment, text extraction, merge."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(whole: object, part: object, top: bool = True) -> bool:
    """Whether ``part`` is contained: objects by key, arrays in any order, scalars by value.

    Only at the top may an array hold a bare scalar.
    """
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contains(whole[k], v, False) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains(w, p, False) for w in whole) for p in part)
    if isinstance(whole, list) and top:
        return any(not isinstance(w, (list, dict)) and contains(w, part, False) for w in whole)
    return isinstance(whole, bool) == isinstance(part, bool) and whole == part


def _plain(v: object) -> bool:
    """A string that no number, constant, array or object renders as."""
    if not isinstance(v, str):
        return False
    try:
        json.loads(v)
    except ValueError:
        return not v.lstrip().startswith(("{", "["))
    return False


def _flat(part: object) -> bool:
    return isinstance(part, dict) and all(_plain(v) and not set(k) & set("'.[]*$") for k, v in part.items())


def json_contains(column: Column | str, filter_json: str | dict | None) -> Column:
    """Rows whose JSON contains the filter; no filter lets all pass, null holds nothing.

    Flat filters of strings become path equalities, which stay in generated
    code; anything deeper runs in one Arrow-batched function.
    """
    c = F.col(column) if isinstance(column, str) else column
    if filter_json is None:
        return F.lit(True)
    part = json.loads(filter_json) if isinstance(filter_json, str) else filter_json
    if _flat(part):
        cond = c.isNotNull()
        for k, v in sorted(part.items()):
            cond = cond & F.coalesce(F.get_json_object(c, f"$['{k}']") == F.lit(v), F.lit(False))
        return cond

    @F.pandas_udf("boolean")
    def deep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t is not None and contains(json.loads(t), part)).astype(bool)

    return deep(c)


def json_text(column: Column | str, key: str) -> Column:
    """The value of a top-level key as text, null where it isn't there."""
    return F.get_json_object(F.col(column) if isinstance(column, str) else column, f"$['{key}']")


def merge(base: str | None, extra: dict) -> str:
    """Top-level merge of JSON objects; null is the empty object."""
    return json.dumps({**(json.loads(base) if base else {}), **extra}, sort_keys=True)
