"""Quality rules: counting rules and an n-gram perplexity band for each language.

The language model is an interpolated modified Kneser-Ney model (Chen & Goodman
1998) over words.  Counts come from the whole of every text, and nothing that stands
often enough to count is left out, so the model grows with the corpus and is held
by no machine whole:

* *Vocabulary*: words that stand twice or more, as 64-bit hashes.  All other words
  share the unknown word, whose probability is spread over their number.
* *One word*: the continuation count of a word, how many different words stand
  before it.
* *Two words*: a pair counts by how many different words stand before it as
  well.  This is the middle order of a three-word model whose top order is
  pruned: a passage that stands in thousands of copies teaches the model each of
  its pairs once, so copies don't become predictable by being copies.  Pairs are
  kept from ``EVIDENCE`` different words on; rarer ones tell a text's own words.

Texts are read in chunks of ``CHUNK`` bytes.  A chunk sends each shard its part of
its sorted distinct keys as one block; the shard merges the blocks of all chunks
and answers to each what its keys have in the whole corpus.  Answers lie in the
shared folder by chunk, where the next pass over the same texts reads them, so a
task holds what its chunk needs, and texts are never shuffled.  There are three
exchanges: words (is it known, and its number), pairs in ``PARTS`` passes (their
evidence), sums by word.  A shard gets about ``SHARD`` tokens, so shards grow in
number, not in size, and no key's group is larger than the vocabulary.

In scripts of three and four bytes, which may have no spaces, every character is
a word of the model.  A document's log perplexity is the mean negative log
probability of its words.  Documents outside their language's band (fences
around the quartiles of that language) are rejected.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbuf
from .cluster import Scratch, ship

U = np.uint64

#: A pair is kept from so many different words before it on.
EVIDENCE = 3
#: Tokens of a shard, about, and keys that a task holds before it sends them.
SHARD, HELD = 1 << 21, 1 << 21
#: Bytes of text that share a local model.
CHUNK = 1 << 24
#: Pairs are counted in so many passes, each of which needs a part of the disk.
PARTS = 3
#: Folders that the sums by word are dealt out to.
SUM_FOLDERS = 64

#: Bands of at most so many languages are broadcast.
MOST_BANDS = 10_000
#: Steps of log perplexity that quartiles are exact to.
STEP = 1e-3

#: What a row of blocks says; sums come before the words that ask for them.
SUM, WORD, PAIR, TOTAL = range(4)
VALUES = 4
ROW = "kind int, shard long, chunk long, n long, keys binary, " + ", ".join(f"v{k} binary" for k in range(VALUES))


# ---- sorted blocks of keys -------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, without the planes that are all zero."""
    top = int(x.max()) if len(x) else 0
    k = max(1, -(-top.bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the sums of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def block_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(kind, shard, chunk, rising keys, values …) as rows of ROW."""
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        value = lambda k: pa.array([pack(r[4 + k]) if len(r) > 4 + k else None for r in part], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([int(r[k]) for r in part], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))), pa.array([len(r[3]) for r in part], pa.int64()), pa.array([pack(np.diff(r[3], prepend=U(0))) for r in part], pa.binary()), *map(value, range(VALUES))],
            names=["kind", "shard", "chunk", "n", "keys", *(f"v{k}" for k in range(VALUES))],
        )


def blocks_in(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """What ``block_batches`` was given; values that aren't as many as the keys say how many they are by their use."""
    columns = [batch.column(c).to_pylist() for c in ("kind", "shard", "chunk", "n", "keys", *(f"v{k}" for k in range(VALUES)))]
    for kind, shard, chunk, n, keys, *values in zip(*columns, strict=True):
        yield kind, shard, chunk, np.cumsum(unpack(keys, n), dtype=np.uint64), values


class Blocks:
    """Keys of a chunk, summed, cut by shard and sent as blocks."""

    def __init__(self, kind: int, shards: int, group: int, counted: bool, chunk: int = 0):
        self.kind, self.shards, self.group, self.counted, self.chunk = kind, shards, U(group), counted, chunk
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.counted:
            keys, c = summed(keys)
            self.counts.append(c)
        else:
            keys = distinct(keys)
        self.keys.append(keys)
        self.n += len(keys)
        if self.n >= HELD:
            self._shrink()
            if self.n >= HELD // 2:
                yield from self.flush()

    def _shrink(self) -> None:
        if self.counted:
            k, c = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.counts = [c]
        else:
            k = distinct(np.concatenate(self.keys))
        self.keys, self.n = [k], len(k)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        self._shrink()
        k = self.keys[0]
        # keys of one group (all but the lowest ``group`` bits) meet in one shard
        shard = textbuf.mix((k >> self.group) + U(1)) % U(self.shards)
        order = np.argsort(shard, kind="stable")
        cut = [x[order] for x in (k, *(self.counts if self.counted else ()))]
        at = np.searchsorted(shard[order], np.arange(self.shards + 1, dtype=np.uint64))
        yield from block_batches([(self.kind, i, self.chunk, *(x[at[i] : at[i + 1]] for x in cut)) for i in np.flatnonzero(np.diff(at))])
        self.keys, self.counts, self.n = [], [], 0


def by_shard(it: Iterator[pa.RecordBatch], finish) -> Iterator[pa.RecordBatch]:
    """Rows in the order of shards to what ``finish`` makes of all blocks of each shard."""
    now, held = None, []
    for batch in it:
        for x in blocks_in(batch):
            if x[1] != now and held:
                yield from block_batches(list(finish(now, held)))
                held = []
            now = x[1]
            held.append(x)
    if held:
        yield from block_batches(list(finish(now, held)))


def exchanged(rows: DataFrame, finish) -> DataFrame:
    """The answers of the shards to the blocks that they get."""
    names = rows.columns
    met = rows.repartition("shard").sortWithinPartitions("shard", "kind").select(*names)
    return met.mapInArrow(textbuf.lean(lambda it: by_shard(it, finish)), ROW).repartition("chunk")


def chunks(it: Iterator[pa.RecordBatch], col: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(name, batches) of spans of CHUNK bytes of text, one document more at most.

    Where a span ends depends on the documents only, and its name on their
    texts, so a second pass over the same rows finds the spans of the first.
    """
    held: list[pa.RecordBatch] = []
    size, name, lengths = 0, hashlib.blake2b(digest_size=8), []

    def ended() -> tuple[int, list[pa.RecordBatch]]:
        name.update(np.concatenate(lengths).astype("<i8").tobytes())
        return int.from_bytes(name.digest(), "little") >> 1 | 1, held

    for batch in it:
        off, data = textbuf.utf8(batch.column(col))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(n, int(np.searchsorted(off[lo + 1 :], off[lo] + CHUNK - size)) + lo + 1)
            held.append(batch.slice(lo, hi - lo))
            name.update(data[off[lo] : off[hi]])
            lengths.append(np.diff(off[lo : hi + 1]))
            size += int(off[hi] - off[lo])
            lo = hi
            if size >= CHUNK:
                yield ended()
                held, size, name, lengths = [], 0, hashlib.blake2b(digest_size=8), []
    if held:
        yield ended()


def answers(folder: str, chunk: int) -> Iterator[tuple]:
    """What the shards have answered to a chunk, read from the shared folder."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    system, top = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{top}/chunk={chunk}", allow_not_found=True)) if f.path.endswith(".parquet")]
    for path in sorted(files):
        t = pq.ParquetFile(system.open_input_file(path)).read()
        yield from blocks_in(t.append_column("chunk", pa.array(np.full(t.num_rows, chunk))))


# ---- words and their probabilities -----------------------------------------------


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the model's words of a run, lower case, and first word of each document."""
    s, e, first = textbuf.words(off, data)
    wide = np.flatnonzero(data >= 0xE0)
    if len(wide):
        # characters of three and four bytes are words of their own
        after = wide + 3 + (data[wide] >= 0xF0)
        s = np.union1d(s, np.concatenate([wide, after[after < len(data)]]))
        s = s[~textbuf.WS[data[s]]]
        own_end = np.append(s[1:], len(data))
        stop = np.sort(np.concatenate([e, own_end]))
        e = stop[np.searchsorted(stop, s, "right")]
        first = np.searchsorted(s, off)
    return textbuf.span_hash(textbuf.prefix(data, textbuf.BYTE_LOWER), s, e), first


@textbuf.lean
def word_batches(it: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for chunk, batches in chunks(it):
        # each chunk asks once at least, so that it is known to have been seen
        yield from block_batches([(WORD, 0, chunk, np.zeros(0, np.uint64), np.zeros(0, np.int64))])
        blocks = Blocks(WORD, shards, 0, True, chunk)
        for batch in batches:
            for _, _, off, data in textbuf.runs(batch.column(0)):
                yield from blocks.add(tokens(off, data)[0])
        yield from blocks.flush()


def finish_words(shard: int, held: list[tuple]) -> Iterator[tuple]:
    """To each chunk its words that stand at least twice in the corpus and the steps of their places among the shard's."""
    counts = [unpack(v[0], len(keys)).astype(np.int64) for _, _, _, keys, v in held]
    words, n = summed(np.concatenate([x[3] for x in held]), np.concatenate(counts))
    known = words[n > 1]
    for _, _, chunk, keys, _ in held:
        at = np.searchsorted(known, keys)
        own = at < len(known)
        own[own] = known[at[own]] == keys[own]
        yield WORD, shard, chunk, keys[own], np.diff(at[own], prepend=0)
    yield TOTAL, shard, 0, np.zeros(0, np.uint64), np.array([len(known), len(words)])


@dataclass
class Vocabulary:
    """Sorted word hashes of a chunk's known words.  A word's number is its place; then come the unknown word and the edge of a text.

    numbers: what each is in the corpus, of ``all`` numbers.
    """

    hashes: np.ndarray
    corpus: np.ndarray
    all: int
    unknown_kinds: int

    @property
    def size(self) -> int:
        return len(self.hashes) + 2

    def numbers(self, h: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        if not n:
            return np.full(len(h), 0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
        return np.where(self.hashes[at] == h, at, n)

    def sequence(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, word before, first word of each document) of a run; before a text stands the edge."""
        h, first = tokens(off, data)
        word = self.numbers(h)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first[:-1][np.diff(first) > 0]] = len(self.hashes) + 1
        return word, before, first

    def pair_keys(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.corpus[before] * U(self.all) + self.corpus[word]


@dataclass
class Numbers:
    """How the shards number the known words of the corpus: first of each shard; then the unknown word and the edge."""

    first: np.ndarray
    unknown_kinds: int

    @property
    def all(self) -> int:
        return int(self.first[-1]) + 2

    def vocabulary(self, hashes: np.ndarray, corpus: np.ndarray) -> Vocabulary:
        return Vocabulary(hashes, np.append(corpus, np.array([self.all - 2, self.all - 1], np.uint64)), self.all, self.unknown_kinds)


def joined(parts: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    """n columns of (keys, values …), by rising keys, each once."""
    if not parts:
        return tuple(np.zeros(0, np.uint64) for _ in range(n))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    keys, at = np.unique(columns[0], return_index=True)
    return keys, *(c[at] for c in columns[1:])


def seen(rows: Iterator[tuple], chunk: int) -> list[tuple]:
    rows = list(rows)
    if not rows:
        raise RuntimeError(f"chunk {chunk}: the texts came in another order or number than in the pass before")
    return rows


@textbuf.lean
def pair_batches(it: Iterator[pa.RecordBatch], folder: str, numbers, shards: int, part: int) -> Iterator[pa.RecordBatch]:
    """For each shard of the part, a chunk's pairs (word before, word), and behind each the different words before it."""
    num: Numbers = numbers.value
    for chunk, batches in chunks(it):
        found = [(keys, np.cumsum(unpack(v[0], len(keys)), dtype=np.uint64) + num.first[shard]) for _, shard, _, keys, v in seen(answers(folder, chunk), chunk)]
        v = num.vocabulary(*joined(found, 2))
        n, unknown, edge, held = v.size, v.size - 2, v.size - 1, []
        for batch in batches:
            for _, _, off, data in textbuf.runs(batch.column(0)):
                word, before, first = v.sequence(off, data)
                if not len(word):
                    continue
                whole = np.flatnonzero(np.diff(first) > 0)
                # each text ends in the edge
                last = first[1:][whole] - 1
                before2 = np.empty_like(before)
                before2[1:] = before[:-1]
                before2[first[:-1][whole]] = edge
                word, before, before2 = (np.concatenate(x) for x in ((word, np.full(len(last), edge)), (before, word[last]), (before2, before[last])))
                before2[before == unknown] = edge  # such a pair counts once
                own = np.flatnonzero((textbuf.mix(v.pair_keys(word, before)) & U(0xFFFF)) % U(PARTS) == U(part))
                held.append(before[own].astype(np.uint64) * U(n) + word[own].astype(np.uint64))
                held.append(before2[own].astype(np.uint64))
        if not held:
            continue
        pair, third = np.concatenate(held[::2]), np.concatenate(held[1::2])
        held.clear()
        if n < 1 << 21:
            three = distinct(pair * U(n) + third)
            pair, third = three // U(n), (three % U(n)).astype(np.int64)
        else:
            pairs, at = np.unique(pair, return_inverse=True)
            three = distinct(at.astype(np.uint64) * U(n) + third)
            pair, third = pairs[(three // U(n)).astype(np.int64)], (three % U(n)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        k = np.diff(start, append=len(pair))
        pair = pair[start]
        key = v.pair_keys((pair % U(n)).astype(np.int64), (pair // U(n)).astype(np.int64))
        shard = (textbuf.mix(key) >> U(16)) % U(shards)
        order = np.lexsort((key, shard))
        key, k, start = key[order], k[order], start[order]
        upto = np.concatenate(([0], np.cumsum(k)))
        third = v.corpus[third[np.repeat(start - upto[:-1], k) + np.arange(upto[-1])]]
        at = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        yield from block_batches([(PAIR, i, chunk, key[at[i] : at[i + 1]], k[at[i] : at[i + 1]], third[upto[at[i]] : upto[at[i + 1]]]) for i in np.flatnonzero(np.diff(at))])


def finish_pairs(shard: int, held: list[tuple], first: np.ndarray) -> Iterator[tuple]:
    """To each chunk its pairs of known words that have the evidence.  To the shards of words, sums by word.

    By word: how many different words stand before it; as a context, all evidence,
    and that and the number of its kept pairs.
    """
    size = U(int(first[-1]) + 2)
    unknown = size - U(2)
    k = [unpack(v[0], len(keys)).astype(np.int64) for _, _, _, keys, v in held]
    third = np.concatenate([unpack(x[4][1], int(c.sum())) for x, c in zip(held, k, strict=True)])
    pairs, at = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
    three = distinct(np.repeat(at.astype(np.uint64), np.concatenate(k)) * size + third)
    c = np.bincount((three // size).astype(np.int64), minlength=len(pairs))
    before, word = pairs // size, pairs % size
    real = before != unknown
    kept = (c >= EVIDENCE) & real & (word != unknown)
    lo = 0
    for _, _, chunk, keys, _ in held:
        own = at[lo : lo + len(keys)]
        lo += len(keys)
        if (m := kept[own]).any():
            yield PAIR, shard, chunk, keys[m], c[own[m]]
    w, to = np.unique(np.concatenate([word, before[real]]), return_inverse=True)
    context = to[len(word) :]
    total = lambda where, x: np.bincount(where, x, minlength=len(w)).astype(np.int64)
    sums = total(to[: len(word)], None), total(context, c[real]), total(context, (c * kept)[real]), total(context, kept[real])
    cut = np.searchsorted(w, np.append(first, size))
    for i in np.flatnonzero(np.diff(cut)):
        yield SUM, i, -1 - i % SUM_FOLDERS, w[cut[i] : cut[i + 1]], *(x[cut[i] : cut[i + 1]] for x in sums)
    yield TOTAL, shard, 0, np.zeros(0, np.uint64), np.bincount(np.minimum(c[real], 5), minlength=6)[1:5]


def finish_sums(shard: int, held: list[tuple], first: np.ndarray) -> Iterator[tuple]:
    """To each chunk, which asks by places in the shard, the sums of its words.  The last shard is that of the unknown word and the edge."""
    special = shard == len(first) - 1
    n = 2 if special else int(first[shard + 1] - first[shard])
    sums = np.zeros((4, n), np.int64)
    for kind, _, _, keys, v in held:
        if kind == SUM:
            at = (keys - first[shard]).astype(np.int64)
            for x, raw in zip(sums, v, strict=False):
                x[at] += unpack(raw, len(keys)).astype(np.int64)
    for kind, _, chunk, keys, v in held:
        if kind == WORD:
            yield WORD, shard, chunk, keys, *sums[:, keys.astype(np.int64)]
    if special:
        yield SUM, shard, 0, np.arange(2, dtype=np.uint64), *sums
    yield TOTAL, shard, 0, np.zeros(0, np.uint64), np.append(sums[0].sum(), np.bincount(np.minimum(sums[0], 5), minlength=6)[1:6])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What modified Kneser-Ney takes from counts of 0, 1, 2 and more."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.1, 0.1], [0, 0.95, 1.9, 2.8])


@dataclass
class Model:
    """Sorted arrays: the vocabulary with P of each word, pairs with their discounted
    probabilities, and by context the weight left to the word alone."""

    vocabulary: Vocabulary
    alone: np.ndarray
    pairs: np.ndarray
    probs: np.ndarray
    left: np.ndarray

    def log_probs(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(word | word before); an unknown word is one of its number."""
        v = self.vocabulary
        p = self.left[before] * self.alone[word]
        if len(self.pairs):
            key = v.pair_keys(word, before)
            i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            # the unknown word is in no pair that is kept
            known = self.pairs[i] == key
            p[known] += self.probs[i[known]]
        out = np.log(p)
        out[word == v.size - 2] -= np.log(max(1, v.unknown_kinds))
        return out


@dataclass
class Learnt:
    """Where the shards' answers lie, and the few figures that all chunks share."""

    folder: str
    numbers: Numbers
    special: np.ndarray  # sums of the unknown word and the edge
    continued: np.ndarray  # pairs, and words that stand behind 1, 2, 3, 4 and more different ones
    repeated: np.ndarray

    def model(self, words: list[tuple], values: list[tuple], pairs: list[tuple]) -> Model:
        """The model of the words and pairs that are given, with the probabilities that they have in the whole corpus."""
        first = self.numbers.first
        corpus, hashes = joined([(np.cumsum(unpack(v[0], len(keys)), dtype=np.uint64) + first[shard], keys) for kind, shard, _, keys, v in words if kind == WORD], 2)
        known, *sums = joined([(keys + first[shard], *(unpack(x, len(keys)) for x in v)) for kind, shard, _, keys, v in values if kind == WORD], 5)
        if not np.array_equal(corpus, known):
            raise RuntimeError("words without sums")
        order = np.argsort(hashes)
        corpus, hashes, *sums = (x[order] for x in (corpus, hashes, *sums))
        n, context, held, kinds = (np.append(x, y).astype(np.int64) for x, y in zip(sums, self.special, strict=True))
        v = self.numbers.vocabulary(hashes, corpus)
        d = discounts(*self.continued[1:5])
        total = max(1, self.continued[0])
        spare = d[1] * self.continued[1] + d[2] * self.continued[2] + d[3] * self.continued[3:].sum()
        alone = (n - d[np.minimum(n, 3)]) / total + (1 - (self.continued[0] - spare) / total) / v.all
        d = discounts(*self.repeated)
        kept, evidence = joined([(keys, unpack(x[0], len(keys)).astype(np.int64)) for kind, _, _, keys, x in pairs if kind == PAIR], 2)
        order = np.argsort(v.corpus)
        before = order[np.searchsorted(v.corpus[order], kept // U(v.all))]
        evidence = evidence.astype(np.int64)
        probs = (evidence - d[np.minimum(evidence, 3)]) / np.maximum(1, context[before])
        left = 1 - (held - d[3] * kinds) / np.maximum(1, context)
        return Model(v, alone, kept, probs, left)

    def of(self, chunk: int) -> Model:
        words = seen(answers(f"{self.folder}/words", chunk), chunk)
        return self.model(words, list(answers(f"{self.folder}/values", chunk)), [x for part in range(PARTS) for x in answers(f"{self.folder}/pairs-{part}", chunk)])


def learn(docs: DataFrame, scratch: Scratch) -> Learnt:
    """Counts all texts of ``docs``; what each chunk needs of the model is left in the shared folder.

    To the driver come a few figures a shard.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, size // (6 * SHARD))  # a word and its space are some six bytes
    pair_shards = -(-shards // PARTS)

    def totals(saved: DataFrame) -> list[tuple]:
        return [x for x in blocks_in(saved.filter("chunk = 0").toArrow()) if x[0] != WORD]

    words = scratch.save(exchanged(texts.mapInArrow(lambda it: word_batches(it, shards), ROW), finish_words), "words", "chunk")
    known = np.zeros(shards, np.uint64)
    kinds = 0
    for _, shard, _, _, v in totals(words):
        known[shard], of_shard = (int(x) for x in unpack(v[0], 2))
        kinds += of_shard
    first = np.concatenate(([0], np.cumsum(known))).astype(np.uint64)
    numbers = Numbers(first, kinds - int(first[-1]))
    shared = spark.sparkContext.broadcast(numbers)  # a number a shard

    folder = scratch.folder()
    repeated, parts = np.zeros(4, np.int64), []
    for part in range(PARTS):
        rows = texts.mapInArrow(lambda it, part=part: pair_batches(it, f"{folder}/words", shared, pair_shards, part), ROW)
        parts.append(scratch.save(exchanged(rows, lambda shard, held: finish_pairs(shard, held, first)), f"pairs-{part}", "chunk"))
        for *_, v in totals(parts[-1]):
            repeated += unpack(v[0], 4).astype(np.int64)

    # the places that stand beside a chunk's words are what it asks by
    nothing = [F.lit(None).cast("binary").alias(f"v{k}") for k in range(VALUES)]
    asked = words.filter("chunk <> 0").select("kind", "shard", "chunk", "n", F.col("v0").alias("keys"), *nothing)
    for p in parts:
        asked = asked.unionByName(p.filter("chunk < 0"))
    values = scratch.save(exchanged(asked, lambda shard, held: finish_sums(shard, held, first)), "values", "chunk")
    special, continued = np.zeros((4, 2), np.int64), np.zeros(6, np.int64)
    for kind, _, _, _, v in totals(values):
        if kind == SUM:
            special = np.stack([unpack(x, 2).astype(np.int64) for x in v[:4]])
        else:
            continued += unpack(v[0], 6).astype(np.int64)
    return Learnt(folder, numbers, special, continued, repeated)


def train(docs: DataFrame, scratch: Scratch | None = None) -> Model:
    """The whole model of all texts of ``docs`` on the driver, for a look at it; scores are given chunk by chunk and don't need it."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "quality")
    with steady(docs, scratch) as docs:
        learnt = learn(docs, scratch)
    rows = lambda name: list(blocks_in(spark.read.schema(ROW).parquet(f"{scratch.top}/{name}").filter("chunk > 0").toArrow()))
    return learnt.model(rows("words"), rows("values"), [x for part in range(PARTS) for x in rows(f"pairs-{part}")])


@contextlib.contextmanager
def steady(docs: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """``docs`` whose rows come in the same order and partitions each time: files cut as they are now, and what is shuffled is saved."""
    conf, key = docs.sparkSession.conf, "spark.sql.files.minPartitionNum"
    own = conf.get(key, None) is None
    if own:
        conf.set(key, str(docs.sparkSession.sparkContext.defaultParallelism))
    try:
        yield scratch.save(docs, "docs") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs
    finally:
        if own:
            conf.unset(key)


# ---- counting rules --------------------------------------------------------------

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def by_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i] : at[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def base_counts(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each document of a run."""
    n_docs = len(off) - 1
    s, e, first = textbuf.words(off, data)
    n_words = np.diff(first)
    lead = ((data & 0xC0) != 0x80) & ~textbuf.WS[data]
    word_chars, n_symbols = by_document(lead, off), by_document(_SYMBOL[data], off)
    c = textbuf.prefix(data)

    # lines: cut at \n and at the ends of documents
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], cut + 1]))
    stop = np.sort(np.concatenate([off[1:], cut]))
    inked = np.searchsorted(s, begin) < np.searchsorted(s, stop)
    begin, stop = begin[inked], stop[inked]
    doc = np.searchsorted(off[1:], begin, "right")
    with np.errstate(over="ignore"):
        salt = textbuf.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
        line = textbuf.mix(textbuf.span_hash(c, begin, stop) + salt[doc])
    _, at = np.unique(line, return_index=True)
    n_dup = np.bincount(doc, minlength=n_docs) - np.bincount(doc[at], minlength=n_docs)

    # windows of three words
    n_rep = np.zeros(n_docs, np.int64)
    if len(s) >= 3:
        h = textbuf.span_hash(c, s, e)
        owner = np.repeat(np.arange(n_docs), n_words)
        with np.errstate(over="ignore"):
            g = textbuf.mix(h[:-2] * U(0xBF58476D1CE4E5B9) + h[1:-1] * U(0x94D049BB133111EB) + h[2:] * U(0xD6E8FEB86659FD93) + salt[owner[:-2]])
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        order = whole[np.argsort(g[whole], kind="stable")]
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(s), bool)
        w = order[twice]
        hit[w] = hit[w + 1] = hit[w + 2] = True
        n_rep = by_document(hit, first)
    return n_words, word_chars, n_symbols, n_dup, n_rep


@textbuf.lean
def score_batches(it: Iterator[pa.RecordBatch], learnt) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text, …) to the counts and the log perplexity; further columns pass through."""
    for chunk, batches in chunks(it, 2):
        m: Model = learnt.value.of(chunk)
        for batch in batches:
            for lo, hi, off, data in textbuf.runs(batch.column(2), 1 << 19):
                counts = base_counts(off, data)
                word, before, first = m.vocabulary.sequence(off, data)
                n = np.diff(first)
                ppl = -by_document(m.log_probs(word, before), first) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in (0, 1, *range(3, batch.num_columns))), *(pa.array(np.asarray(x, np.int64)) for x in counts), pa.array(np.where(n > 0, ppl, np.nan))],
                    names=["doc_id", "lang", *batch.schema.names[3:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"],
                )


def bands(scored: DataFrame, below: float, above: float, least_width: float) -> DataFrame:
    """(lang, low, high) from the documents of each language, copies of one text counted once.

    Quartiles are exact to STEP: documents are counted by steps of log perplexity
    first, so a language is a bounded histogram however many documents it has.
    """
    step = F.round(F.col("log_perplexity") / STEP).cast("long")
    apart = scored.select("lang", step.alias("step"), "n_words", "word_chars").distinct()
    hist = apart.groupBy("lang", "step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("step"))
    hist = hist.withColumn("upto", upto).withColumn("all", F.sum("n").over(W.partitionBy("lang")))

    def quartile(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("step"))) * STEP

    q = hist.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))

    def width(fence: float) -> Column:
        return F.greatest(fence * (F.col("q3") - F.col("q1")), F.lit(least_width))

    return q.select("lang", (F.col("q1") - width(below)).alias("low"), (F.col("q3") + width(above)).alias("high"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, below: float = 8.0, above: float = 2.0, least_width: float = 0.3, with_rows: bool = False) -> DataFrame:
    """Counts, perplexity and verdict of every document of (doc_id, text, lang).

    The band of a language reaches from ``below`` quartile distances under the
    lower quartile of the log perplexity of its documents that pass the counting
    rules to ``above`` of them over the upper one (``least_width`` at least, where
    copies leave next to no distance).  It is wider below: a good text that many
    near copies share is easier to foretell, and which copy stays isn't for this
    rule to say.  A null language has a band
    of its own, apart from any that is named.  Null and empty texts have no words
    and fail the counting rules.  One row a row of ``docs``; with_rows adds own, a
    struct of all columns of docs.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")] if with_rows else []
    rows = docs.select("doc_id", "lang", "text", *own)
    passed = f"own {rows.schema['own'].dataType.simpleString()}, " if with_rows else ""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    with steady(rows, scratch) as rows:
        learnt = spark.sparkContext.broadcast(learn(rows, scratch))  # a number a shard
        scored = rows.mapInArrow(
            lambda it: score_batches(it, learnt),
            f"doc_id {kind}, lang string, {passed}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double",
        )
        scored = scratch.save(scored.withColumn("base_failed", failed), "scored")
    scratch.drop("docs", "words", "values", *(f"pairs-{part}" for part in range(PARTS)))
    limits = scratch.save(bands(scored.filter(~F.col("base_failed")), below, above, least_width), "bands").withColumnRenamed("lang", "_lang")
    if limits.count() <= MOST_BANDS:  # one small row a language
        limits = F.broadcast(limits)
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(kept, F.lit(False)).alias("kept"), "log_perplexity", "low", "high", *(["own"] if with_rows else []),
    )
