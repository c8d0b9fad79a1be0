"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the
n-grams of one to three characters are hashed into 2**15 features with TF-IDF
weights of unit length.  Document frequencies are counted over all rows that
may be learnt from.  The weights are trained by follow-the-regularised-leader
with elastic-net penalties (McMahan et al. 2013) on a bounded sample of each
language, and the scores are calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship
from .fit import bounded, held_out

DIM = 1 << 15
ORDERS = (1, 2, 3)
#: At most so many documents of each language are fitted on.
SAMPLE = 500

_U = np.uint32
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and how often each stands in it; None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = letter_table()[c]
    if not ink.any():
        return None
    c = np.where(ink, c, _U(32))
    keep = np.ones(len(c), bool)
    keep[1:] = ink[1:] | ink[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    h, out = np.zeros(len(c), np.uint32), []
    with np.errstate(over="ignore"):
        for k in ORDERS:
            h = h[: len(c) - k + 1] * _U(0x01000193) + c[k - 1 :] * _U(0x9E3779B1) + _U(k)
            x = h ^ (h >> _U(15))
            out.append((x * _U(0x85EBCA6B)) >> _U(32 - 15))
    grams = np.concatenate(out)
    if len(grams) < DIM // 8:  # a short text isn't worth a table of all features
        return np.unique(grams.astype(np.int64), return_counts=True)
    n = np.bincount(grams, minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIM + 1, languages); the last row is the bias
    temperature: float = 1.0

    def vector(self, f: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        v = np.log1p(f[1]) * self.idf[f[0]]
        return v / max(np.sqrt((v * v).sum()), 1e-12)

    def scores(self, text: str | None) -> np.ndarray | None:
        f = features(text)
        if f is None:
            return None
        z = (self.vector(f) @ self.weights[f[0]] + self.weights[DIM]) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Per-coordinate FTRL-proximal over (indices, values) rows; returns the weights."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, v = np.append(x[i][0], DIM), np.append(x[i][1], 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p[None]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def _frequency_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in it:
        for text in batch.column(0).to_pylist():
            n += 1
            if (f := features(text)) is not None:
                df[f[0]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM), pa.int32()), pa.array(np.append(df[at], n))], names=["feature", "n"])


def _sample_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        got = [features(t) for t in batch.column(1).to_pylist()]
        ok = [i for i, f in enumerate(got) if f is not None]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(ok, pa.int64())), batch.column(2).take(pa.array(ok, pa.int64())), pa.array([got[i][0].astype(np.int32) for i in ok], pa.list_(pa.int32())), pa.array([got[i][1].astype(np.int32) for i in ok], pa.list_(pa.int32()))],
            names=["doc_id", "lang", "at", "n"],
        )


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on (doc_id, text, lang) rows that aren't held out and have a language."""
    ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    freq = known.select("text").mapInArrow(_frequency_batches, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1)
    df[freq["feature"].to_numpy()] = freq["n"].to_numpy()
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded(known, "lang", sample).select("doc_id", "text", "lang").mapInArrow(_sample_batches, f"doc_id {kind}, lang string, at array<int>, n array<int>").toArrow().sort_by([(c, "ascending") for c in ("doc_id", "lang")])
    langs = sorted(set(rows["lang"].to_pylist()))
    model = Model(langs or ["und"], idf, np.zeros((DIM + 1, max(1, len(langs)))))
    if len(langs) < 2:
        return model
    at, n = rows["at"].combine_chunks(), rows["n"].combine_chunks()
    x = [(a, model.vector((a, b))) for a, b in ((at[i].values.to_numpy(), n[i].values.to_numpy()) for i in range(len(at)))]
    y = np.array([langs.index(v) for v in rows["lang"].to_pylist()])
    aside = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~aside) if aside.sum() >= 2 * len(langs) else np.arange(len(y))
    model.weights = ftrl([x[i] for i in fit], y[fit], len(langs))
    # one temperature, by the likelihood of the rows set aside
    test = np.flatnonzero(aside) if aside.any() else fit
    s = np.array([x[i][1] @ model.weights[x[i][0]] + model.weights[DIM] for i in test])

    def loss(t: float) -> float:
        z = s / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(test)), y[test]]).mean())

    model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); ``und`` and 0 where there is no letter."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # 2**15 weights a language

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            got = [m.scores(t) for t in batch.column(2).to_pylist()]
            best = [int(p.argmax()) if p is not None else -1 for p in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m.langs[k] if k >= 0 else "und" for k in best], pa.string()), pa.array([float(p[k]) if k >= 0 else 0.0 for p, k in zip(got, best, strict=True)], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the rows that may be learnt from, predict every row.

    Without two languages to learn from, the one there is (or ``und``) is given.
    """
    return predict(docs, train(docs, sample))
