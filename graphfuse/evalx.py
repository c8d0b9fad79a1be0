"""Evaluation: agreement of result lists, latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import jaccard


def percentile(values: list[float], p: float) -> float:
    """The value at index min(n - 1, int(n p)) of the sorted values."""
    v = sorted(values)
    return v[min(len(v) - 1, int(len(v) * p))]


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, jaccard) of two results (query_id, chunk_id); two empty ones agree."""
    x = a.groupBy("query_id").agg(F.collect_set("chunk_id").alias("x"))
    y = b.groupBy("query_id").agg(F.collect_set("chunk_id").alias("y"))
    both = x.join(y, "query_id", "full")
    empty = F.array().cast(x.schema["x"].dataType)
    return both.select("query_id", jaccard(F.coalesce("x", empty), F.coalesce("y", empty)).alias("jaccard"))
