"""Small linear models fitted on the driver, and the held-out rule they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def order_key(doc_id: str | Column = "doc_id") -> Column:
    """A fixed order of documents that has nothing to do with their content."""
    return F.xxhash64(doc_id, F.lit("sample"))


def bounded(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``label``, the same ones each run.

    Values are compared by a cut-off of the order key: one bounded aggregate a
    value, then a filter, and no row leaves its place.
    """
    keyed = rows.withColumn("_key", order_key())
    share = keyed.groupBy(label).agg(F.count("*").alias("n")).collect()
    cond = F.lit(False)
    for r in share:
        if r[label] is None:
            continue
        # the keys are uniform over 64 bits, so a share of their range is a share of the rows
        part = min(1.0, most / r["n"])
        cut = int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1
        cond = cond | ((F.col(label) == F.lit(r[label])) & (F.col("_key") <= F.lit(cut)))
    return keyed.filter(cond).drop("_key")


def label_weights(rows: DataFrame, sample: DataFrame, label: str) -> dict[object, float]:
    """The weight of a sampled row of each label that restores the shares of ``rows``; 1 on average."""
    n, own = (dict(map(tuple, d.groupBy(label).count().collect())) for d in (rows, sample))
    scale = sum(own.values()) / max(1, sum(n[k] for k in own))
    return {k: n[k] / own[k] * scale for k in own}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w
