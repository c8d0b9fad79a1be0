"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols: insult (of a learnt weight), threat, intent, target,
negation, report, other.  Small deterministic transducers read the symbols of a
clause and give each a factor:

* insult passes insults on;
* threat passes threats on, in full only a few words behind an intent ("will kill");
* target raises what follows a target in the clause;
* negation lowers the next few words;
* report lowers the rest of the clause;
* object, which reads from the clause's end, raises what a target follows, most
  within a few words ("kill you").

Insult and threat are united (their factors add); the result is composed with
the others (factors multiply), and with the one from the right to a bimachine,
which is the grammar.  A clause's score is the sum of its weights times factors.

A clause ends at a sentence or clause mark or a line break.  A document's
features are the sum and the largest of its clause scores and the number of
matched clauses, logistically calibrated.  The insult patterns (word beginnings
with weights) are learnt from labelled rows; the calibration sees each of them
under patterns learnt from the other half.  The other lists are fixed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .cluster import ship
from .fit import bounded, held_out, label_weights, logistic, sigmoid

#: At most so many labelled documents of each label are fitted on.
SAMPLE = 4_000
#: Word beginnings of so many characters can become patterns.
SHORTEST, LONGEST = 3, 10
#: A pattern needs this much evidence (G statistic) and this odds ratio.
EVIDENCE, ODDS = 20.0, 20.0

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
SYMBOLS = 7

#: Words of each symbol, in English, French, German and Spanish.
WORDS = {
    THREAT: "kill killing murder destroy hurt strangle stab shoot tuer tuerai frapper töten umbringen schlagen matar mataré matarte golpear",
    INTENT: "will i'll we'll shall gonna going must vais va allons werde werden wird voy vamos vas",
    TARGET: "you your you're yourself u ur y'all toi vous votre ton ta dich dir euch dein deine usted ustedes tú tu vosotros",
    NEGATION: "not no never isn't aren't wasn't don't doesn't won't nobody jamais nicht kein keine niemals nie nunca jamás ningún",
    REPORT: "said says quoted quote wrote reported alleged claimed called dit disait déclare sagte sagt schrieb behauptete dijo dice escribió",
}


@dataclass
class Transducer:
    """A deterministic weighted transducer from state 0: to[state, symbol] and factor[state, symbol]."""

    to: np.ndarray
    factor: np.ndarray

    def _product(self, other: "Transducer", op) -> "Transducer":
        n, m = len(self.to), len(other.to)
        to = self.to[:, None] * m + other.to[None]
        return Transducer(to.reshape(n * m, SYMBOLS), op(self.factor[:, None], other.factor[None]).reshape(n * m, SYMBOLS))

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """Composition over the same symbols: both move, the factors multiply."""
        return self._product(other, np.multiply)

    def __or__(self, other: "Transducer") -> "Transducer":
        """Union: both move, the factors add."""
        return self._product(other, np.add)

    def others(self, most: int) -> np.ndarray:
        """State after 0 to ``most`` other words from each state."""
        out = [np.arange(len(self.to))]
        for _ in range(most):
            out.append(self.to[out[-1], OTHER])
        return np.array(out)


def machine(states: int, rule) -> Transducer:
    """A transducer whose rule gives (next state, factor) of each state and symbol."""
    cells = [[rule(q, s) for s in range(SYMBOLS)] for q in range(states)]
    return Transducer(np.array([[c[0] for c in row] for row in cells]), np.array([[c[1] for c in row] for row in cells], float))


#: So many words an intent, a negation and an object reach at most.
REACH = 3
_STRONG = (INSULT, THREAT)


def _insult() -> Transducer:
    return machine(1, lambda q, s: (0, float(s == INSULT)))


def _threat(bare: float = 0.4) -> Transducer:
    return machine(REACH + 1, lambda q, s: (REACH if s == INTENT else max(0, q - 1), (1.0 if q else bare) if s == THREAT else 0.0))


def _target(gain: float = 1.5) -> Transducer:
    return machine(2, lambda q, s: (int(q or s == TARGET), gain if q and s in _STRONG else 1.0))


def _negation(loss: float = 0.3) -> Transducer:
    return machine(REACH + 1, lambda q, s: (REACH if s == NEGATION else max(0, q - 1), loss if q and s in _STRONG else 1.0))


def _report(loss: float = 0.5) -> Transducer:
    return machine(2, lambda q, s: (int(q or s == REPORT), loss if q and s in _STRONG else 1.0))


def _object(near: float = 1.5, far: float = 1.25) -> Transducer:
    """From the right.  State 0: no target yet; 1: one stands further on; above: within REACH words."""
    gain = lambda q: near if q > 1 else far if q else 1.0
    return machine(REACH + 2, lambda q, s: (REACH + 1 if s == TARGET else max(1, q - 1) if q else 0, gain(q) if s in _STRONG else 1.0))


#: The grammar: what reads from the left, and what reads from the right.
LEFT = (_insult() | _threat()) @ _target() @ _negation() @ _report()
RIGHT = _object()


def _factors(m: Transducer, first: np.ndarray, size: np.ndarray, gap: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Factors of the symbols of all clauses, which are read side by side.

    first, size: where each clause's symbols begin and how many it has; gap: other
    words before each symbol since the one read before it.
    """
    out = np.empty(len(symbol))
    others = m.others(int(gap.max(initial=0)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    state = np.zeros(len(first), np.int64)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # clauses of more than k symbols
    for k, n in enumerate(live):
        at = first[:n] + k
        q = others[gap[at], state[:n]]
        out[at] = m.factor[q, symbol[at]]
        state[:n] = m.to[q, symbol[at]]
    return out


def clause_scores(clause: np.ndarray, place: np.ndarray, symbol: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clauses and their scores under the grammar, from their words other than OTHER in order.

    Time is linear in the words; a longer run of other words acts like one of
    REACH + 2, after which no machine remembers how many there were.
    """
    ids, first, size = np.unique(clause, return_index=True, return_counts=True)
    fresh = np.ones(len(clause), bool)
    fresh[1:] = clause[1:] != clause[:-1]
    gap = np.zeros(len(clause), np.int64)
    gap[1:] = np.diff(place) - 1
    gap = np.minimum(gap, REACH + 2)
    gap[fresh] = 0
    value = weight * _factors(LEFT, first, size, gap, symbol)
    back = np.zeros(len(clause), np.int64)
    back[1:] = gap[1:][::-1]
    back_last = len(clause) - (first + size)  # a clause's last symbol comes first
    back[back_last] = 0
    value *= _factors(RIGHT, back_last, size, back, symbol[::-1])[::-1]
    return ids, np.add.reduceat(value, first) if len(first) else value


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """Score of one clause."""
    s, w = np.array(symbols, np.int64), np.array(weights, float)
    at = np.flatnonzero(s != OTHER)
    return float(clause_scores(np.zeros(len(at), np.int64), at, s[at], w[at])[1].sum())


#: Whether a code point is a letter of _WORD; there are none beyond.
_LETTER = np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x32400)] + [False])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:,|\n"]] = True


def prepared(texts: pa.Array) -> pa.Array:
    """Lowered texts with one kind of apostrophe, as learning and scoring read them."""
    return pc.replace_substring(pc.utf8_lower(texts), "’", "'")


def letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of a letter, as _WORD has them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    out = _LETTER[data]
    high = lead[data[lead] >= 0x80]
    if len(high):
        spare = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        size = 2 + (data[high] >= 0xE0).astype(np.int64) + (data[high] >= 0xF0)
        point = spare[high] & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | spare[high[more] + k] & 0x3F
        own = _LETTER[np.minimum(point, len(_LETTER) - 1)]
        for k in range(4):
            out[high[size > k] + k] = own[size > k]
    return out


def spans(ink: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``ink``, cut at the edges of documents."""
    n = len(ink)
    fresh, last = np.ones(n, bool), np.ones(n, bool)
    fresh[1:], last[:-1] = ~ink[:-1], ~ink[1:]
    cut = off[(off > 0) & (off < n)]
    fresh[cut] = True
    last[cut - 1] = True
    return np.flatnonzero(ink & fresh), np.flatnonzero(ink & last) + 1


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    e = np.cumsum([len(r) for r in raw])
    return textbuf.span_hash(textbuf.prefix(data), e - [len(r) for r in raw], e)


@dataclass
class Lexicon:
    """Pattern weights by byte length, and hashes of the fixed words."""

    patterns: dict[str, float]
    words_of: dict[int, str] = field(default_factory=lambda: WORDS)
    by_length: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    fixed: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        sizes = sorted({len(p.encode()) for p in self.patterns})
        for n in sizes:
            own = [p for p in self.patterns if len(p.encode()) == n]
            h = _hash(own)
            order = np.argsort(h)
            self.by_length.append((n, h[order], np.array([self.patterns[p] for p in own])[order]))
        words = [(w, s) for s, text in self.words_of.items() for w in text.split()]
        h = _hash([w for w, _ in words])
        order = np.argsort(h)
        self.fixed = h[order], np.array([s for _, s in words])[order]

    def clauses(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all clauses of a run that hold an insult or a threat."""
        none = np.zeros(0, np.int64), np.zeros(0)
        letter = letters(data)
        runs = spans(letter, off)
        # runs that an apostrophe joins are one word; each of them can be an insult
        ink = letter.copy()
        joint = np.flatnonzero((data[1:-1] == 0x27) & letter[:-2] & letter[2:]) + 1
        ink[joint[~np.isin(joint, off) & ~np.isin(joint + 1, off)]] = True
        s, e = spans(ink, off)
        if not len(s):
            return none
        first = np.searchsorted(s, off)
        c = textbuf.prefix(textbuf.lower_latin(data), textbuf.BYTE_LOWER)
        symbol, weight = np.zeros(len(s), np.int8), np.zeros(len(s))
        word = np.searchsorted(s, runs[0], "right") - 1
        keys, kinds = self.fixed
        for own, a, b in ((word, *runs), (np.arange(len(s)), s, e)):
            h = textbuf.span_hash(c, a, b)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            symbol[own[known]] = kinds[at[known]]
        weight[symbol == THREAT] = 1.0
        a, b = runs
        for n, hashes, values in self.by_length:
            long = np.flatnonzero(b - a >= n)
            h = textbuf.span_hash(c, a[long], a[long] + n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            symbol[word[long[hit]]] = INSULT
            np.maximum.at(weight, word[long[hit]], values[at[hit]])
        strong = (symbol == INSULT) | (symbol == THREAT)
        if not strong.any():
            return none
        # a clause ends after a word that a clause mark follows, and with its document
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_STOP[data], out=stops[1:])
        nxt = np.append(s[1:], len(data))
        ends = stops[nxt] > stops[e]
        ends[first[1:][first[1:] > 0] - 1] = True
        clause = np.zeros(len(s), np.int64)
        clause[1:] = np.cumsum(ends[:-1])
        matched = np.zeros(clause[-1] + 1, bool)
        matched[clause[strong]] = True
        at = np.flatnonzero(matched[clause] & (symbol != OTHER))
        ids, score = clause_scores(clause[at], at, symbol[at].astype(np.int64), weight[at])
        return np.searchsorted(first, np.searchsorted(clause, ids), "right") - 1, score


def document_features(lexicon: Lexicon, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(bias, log sum, largest, log matched clauses) of each document of a run."""
    n = len(off) - 1
    doc, score = lexicon.clauses(off, data)
    top = np.zeros(n)
    np.maximum.at(top, doc, score)
    return np.stack([np.ones(n), np.log1p(np.bincount(doc, score, minlength=n)), top, np.log1p(np.bincount(doc, minlength=n))], axis=1)


_WORD = re.compile(r"[^\W\d_][^\W\d_'’]*")  # what ``letters`` marks: training and scoring cut alike


def _beginnings(text: str | None) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text or "")):
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            out.add(w[:n])
    return out


def _pattern_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, half) to (pattern, half, bad, good): documents of each label that hold it."""
    seen: Counter = Counter()
    for batch in it:
        for label, text, half in zip(batch.column(0).to_pylist(), prepared(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
            seen.update((half, label, p) for p in _beginnings(text))
            seen[half, label, ""] += 1
        if len(seen) > 1 << 20:
            yield _counted(seen)
            seen.clear()
    yield _counted(seen)


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list({(half, p) for half, _, p in seen})
    bad, good = ([seen.get((half, label, p), 0) for half, p in keys] for label in (1, 0))
    return pa.RecordBatch.from_arrays(
        [pa.array([p for _, p in keys], pa.string()), pa.array([half for half, _ in keys], pa.int32()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())],
        names=["pattern", "half", "bad", "good"],
    )


def learn_patterns(rows: DataFrame) -> list[dict[str, float]]:
    """Word beginnings that mark documents of label 1, with log odds weights: of all rows, and of either half.

    rows: (label, text, half), bounded; half is 0 or 1.  A longer pattern is
    dropped where a shorter beginning of it is as sure.
    """
    counted = rows.select("label", "text", "half").mapInArrow(_pattern_batches, "pattern string, half int, bad long, good long")
    own = lambda c, k: F.sum(F.when(F.col("half") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counted = counted.groupBy("pattern").agg(*(own(c, k) for k in (0, 1) for c in ("bad", "good")))
    # what can't mark label 1 stays where it is
    t = counted.filter("pattern = '' or bad0 + bad1 >= 3").toArrow()
    names = np.array(t["pattern"].to_pylist(), object)
    n = {c: t[c].to_numpy().astype(float) for c in ("bad0", "good0", "bad1", "good1")}
    return [_weights(names, n["bad0"] + n["bad1"], n["good0"] + n["good1"]), *(_weights(names, n[f"bad{k}"], n[f"good{k}"]) for k in (0, 1))]


def _weights(names: np.ndarray, bad: np.ndarray, good: np.ndarray) -> dict[str, float]:
    whole = np.flatnonzero(names == "")
    if not len(whole) or not bad[whole[0]] or not good[whole[0]]:
        return {}
    n1, n0 = bad[whole[0]], good[whole[0]]
    odds = (bad + 0.1) / n1 / ((good + 0.1) / n0)
    share = n1 / (n1 + n0)
    seen = np.maximum(bad + good, 1e-9)
    g = 2 * (bad * np.log((bad + 1e-9) / (seen * share)) + good * np.log((good + 1e-9) / (seen * (1 - share))))
    found = np.flatnonzero((names != "") & (bad >= 3) & (odds >= ODDS) & (g >= EVIDENCE))
    weight = {names[i]: min(float(np.log(odds[i])), 8.0) for i in found}
    return {p: w for p, w in weight.items() if not any(p[:k] in weight and weight[p[:k]] >= w - 1.0 for k in range(SHORTEST, len(p)))}


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def _calibration_batches(it: Iterator[pa.RecordBatch], halves: list[Lexicon]) -> Iterator[pa.RecordBatch]:
    """(label, text, half) to the features under the patterns of the other half."""
    for batch in it:
        half = batch.column(2).to_numpy()
        for lo, hi, off, data in textbuf.runs(prepared(batch.column(1))):
            a, b = (document_features(x, off, data) for x in halves)
            x = np.where((half[lo:hi] == 0)[:, None], b, a)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x[:, k]) for k in range(1, 4))], names=["label", "a", "b", "c"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: dict[int, str] = WORDS) -> Model:
    """Learn patterns and calibration from labelled rows that aren't held out.

    The bounded sample of ids (2 * sample at most) is broadcast to the texts, and
    the patterns of these texts come to the driver.  The calibration weighs its
    rows so that labels count as in all learnable rows.
    """
    ship(docs.sparkSession)
    marked = labels.select("doc_id", F.col("toxic").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    ids = bounded(marked, "label", sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("label").cast("int").alias("label"), "text", half)
    every, *halves = learn_patterns(rows)
    lexicon = Lexicon(every, words)
    parts = [Lexicon(p or every, words) for p in halves]
    t = rows.mapInArrow(lambda it: _calibration_batches(it, parts), "label int, a double, b double, c double").toArrow().sort_by([(c, "ascending") for c in ("label", "a", "b", "c")])
    x = np.stack([np.ones(t.num_rows), *(t[c].to_numpy() for c in "abc")], axis=1)
    y = t["label"].to_numpy().astype(float)
    by_label = label_weights(marked, ids, "label")
    weight = np.array([by_label[k] for k in t["label"].to_pylist()])
    return Model(lexicon, logistic(x, y, ridge=0.1, weight=weight) if len(y) else np.array([-3.0, 1.0, 0.5, 0.0]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses) of every whole text; null is empty."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, off, data in textbuf.runs(prepared(batch.column(2))):
                x = document_features(model.lexicon, off, data)
                p = sigmoid(x @ model.weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 3])).astype(np.int64))],
                    names=["doc_id", "held_out", "score", "predicted", "n_clauses"],
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_clauses long")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows that may be learnt from, score every row."""
    return score(docs, train(docs, labels, sample))
