"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text.  The weights are
learnt from preference pairs, a document marked good against one marked bad:
P(good beats bad) = sigmoid(score difference), so the loss is logistic on the
difference of the features (Bradley & Terry 1952).  The threshold is the
quantile of the scores at the share of bad documents among the labelled ones,
both taken over all rows that may be learnt from, also those that the weights
aren't fitted on; it is mapped to CUT on the 0 to 1 scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .cluster import Scratch, ship
from .fit import bounded, held_out, logistic, sigmoid
from .quality_rules import base_counts, by_document

#: At most so many labelled documents of each label are fitted on.
SAMPLE = 20_000
#: Partners of each document of the rarer label.
PARTNERS = 8
CUT = 0.3

#: Groups of ASCII characters whose share of the words is a feature.
MARKS = ("0123456789", "\n\v\f\r", ".,", "!?", "[]<>|", "#*$%&", "'\"`-_:;(){}/\\=+~^@")
#: Each raw feature is taken as it is and through these steps, so that a linear score can bend.
STEPS = (0.05, 0.2, 0.5)


def _group_table() -> np.ndarray:
    """Group of each byte: 1 to 7 as in MARKS, 8 for control characters, 0 for the rest."""
    out = np.zeros(256, np.uint8)
    out[:32] = out[127] = 8
    out[[9, 32]] = 0
    for k, group in enumerate(MARKS):
        out[[ord(c) for c in group]] = k + 1
    return out


_GROUP = _group_table()


def text_features(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of raw features, from 0 to about 1, for each document of a run."""
    n_words, word_chars, n_symbols, n_dup, n_rep = base_counts(off, data)
    s, e, first = textbuf.words(off, data)
    h = textbuf.span_hash(textbuf.prefix(data, textbuf.BYTE_LOWER), s, e)
    w = np.maximum(n_words, 1)
    group = _GROUP[data]
    up = (data >= 65) & (data <= 90)
    shout = up.copy()
    shout[1:] &= up[:-1]  # capitals behind a capital
    shout[off[:-1][off[:-1] < len(data)]] = False
    shares = [by_document(x, off) / (5 * w) for x in (shout, *(group == k for k in range(1, 9)))]
    owner = np.repeat(np.arange(len(w)), n_words)
    echo = np.zeros(len(h), bool)
    if len(h) > 1:
        echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    # distinct words: a word counts once for each document
    with np.errstate(over="ignore"):
        key = textbuf.mix(h + textbuf.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, one = np.unique(key, return_index=True)
    distinct = np.bincount(owner[one], minlength=len(w)) / w
    lines = by_document(data == 10, off) + 1
    return np.stack(
        [*shares, n_symbols / (3 * w), n_rep / w, n_dup / lines, by_document(echo, first) / w, distinct, np.minimum(word_chars / w / 20, 2), np.log1p(n_words) / 10, np.minimum(w / lines / 200, 2)],
        axis=1,
    ).astype(np.float32)


def expand(x: np.ndarray) -> np.ndarray:
    """Raw features, their square roots, and how far each is past some steps."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), *(np.clip(x - s, 0, s) / s for s in STEPS)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def margin(self, raw: np.ndarray) -> np.ndarray:
        return (expand(raw) - self.mean) / self.scale @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(raw) - self.threshold + np.log(CUT / (1 - CUT)))


def bradley_terry(raw: np.ndarray, label: np.ndarray, partners: int = PARTNERS, ridge: float = 3.0) -> Model:
    """Fit on preference pairs (a document of label 1 over one of label 0)."""
    x = expand(raw)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    model = Model(mean, scale, np.zeros(x.shape[1]), 0.0)
    if not len(good) or not len(bad):
        model.threshold = -1.0 if len(good) else 1.0
        return model
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    rng = np.random.default_rng(0)
    a, b = np.repeat(few, partners), rng.choice(many, len(few) * partners)
    diff = x[b] - x[a] if few is bad else x[a] - x[b]
    # each pair stands in both directions, so no bias is fitted
    model.weights = logistic(np.concatenate([diff, -diff]), np.repeat([1.0, 0.0], len(diff)), ridge, weight=np.full(2 * len(diff), 1 / partners))
    model.threshold = float(np.quantile(x @ model.weights, len(bad) / len(label)))
    return model


def _feature_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo, hi, off, data in textbuf.runs(batch.column(1), 1 << 19):
            raw = text_features(off, data)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in raw], pa.binary())], names=["doc_id", "raw"])


def threshold(margins: DataFrame) -> float:
    """The quantile of ``margin`` at the share of label 0, over all rows of (label, margin)."""
    n, bad = margins.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    k = bad / n * (n - 1)
    # the two rows around the quantile; half a rank keeps rounding from moving them
    at = [(min(int(k) + i, n - 1) + 0.5) / n for i in (0, 1)]
    low, high = margins.agg(F.percentile_approx("margin", at, 100_000)).first()[0]
    return low + (k - int(k)) * (high - low)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    labels: doc_id and quality (1 good, 0 bad; null is no label).  Null and empty
    texts have the features of a text of no words.  Texts are read once; what is
    kept of each is about a hundred bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "quality-classifier")
    kind = docs.schema["doc_id"].dataType.simpleString()
    feats = scratch.save(docs.select("doc_id", "text").mapInArrow(_feature_batches, f"doc_id {kind}, raw binary"), "features")
    marked = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    rows = feats.join(bounded(marked, "label", sample), "doc_id").select("doc_id", "label", "raw").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    width = text_features(np.zeros(2, np.int64), np.zeros(0, np.uint8)).shape[1]
    raw = np.frombuffer(b"".join(rows["raw"].to_pylist()), np.float32).reshape(-1, width)
    model = bradley_terry(raw, rows["label"].to_numpy()) if len(raw) else Model(np.zeros(width * 5), np.ones(width * 5), np.zeros(width * 5), 0.0)

    def margins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.margin(x), pa.float64())], names=["label", "margin"])

    if len(set(rows["label"].to_pylist())) == 2:
        every = feats.join(marked, "doc_id").select(F.col("label").cast("int").alias("label"), "raw")
        model.threshold = threshold(scratch.save(every.mapInArrow(margins, "label int, margin double"), "margins"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, width)
                p = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return feats.select("doc_id", held_out().alias("held_out"), "raw").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
