"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk (Chakraborty, Goldenberg & Koucky 2016) reads a string with
one pointer: step j outputs the character under the pointer and moves on or
stays, as a random bit of (j, character) says.  Two strings of small edit
distance, walked with the same bits, fall into step again after an edit, so
their outputs have small Hamming distance.  Bit sampling then gives hash keys:
each table keeps the outputs of some of the steps.

Every word of an item opens a window over the rest of the item; every word of a
text opens one as well, whether white space, a mark or the edge of the text
stands before it (``starts``).  Windows that agree in a table propose that the item
stands in the text, at the place that lines the two words up.  An exact search
(Myers 1999, bit-parallel edit distance, free ends) over that place decides.
With an edit in every twentieth character a window of the walk's reach is
whole with probability 0.4; an item of ``SHORT`` bytes or more has dozens of
words, two walks and three tables each, so proposals miss it about never.

Shorter items have too few windows for that.  They are cut into one piece more
than they may have edits, one of which stands unchanged in every leak; every
place of the text is looked up among the pieces, so none is missed.

A phrase that many items share proposes all of them wherever it stands.  So
proposals are thinned out side by side first: an item's parts of 64 bytes each
have some least edit distance near their place, and in a leak these add up to no
more than the allowed edits.  What is left is searched exactly.

Texts and items are compared with ASCII and Latin-1 letters lowered and white space run
together.  The benchmark's keys are sent to the tasks in blocks of items of
bounded size, one pass over the corpus a block; the corpus is never shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .cluster import ship

U = np.uint32
#: Steps of a walk, and steps kept in each table.
STEPS, KEPT = 40, 22
TABLES = 3
#: Independent walks.
REPEATS = 2
#: Items of fewer bytes are proposed by exact pieces of at most ``PIECE`` bytes.
SHORT, PIECE = 128, 8
#: Proposals that are thinned out at once; of fewer than FEW in a run each is searched.
AT_ONCE, FEW = 1 << 14, 48
#: Items and bytes of a block, about; keys take some ten times the bytes of the texts.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
#: Allowed edits as a share of an item's length.
RATE = 0.1
#: Proposals are told apart to so many bytes.
CELL = 16
#: Bits of the first filter in front of the key table.
FILTER_BITS = 22


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with white space run together, and where each stood."""
    data = textbuf.lower_latin(data)
    ws = textbuf.WS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(ws[1:] & ws[:-1])
    at = np.flatnonzero(keep)
    out = textbuf.LOWER[data[at]]
    out[ws[at]] = 32
    return out, at


#: Kinds of bytes: white space, marks, letters and digits, scripts without spaces, rest of a character.
GAP, MARK, LETTER, DENSE, REST = range(5)
#: A word opens windows at all its characters from this one on.
LONG_WORD = 16


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    kind[32] = GAP
    for a, z in ((48, 58), (65, 91), (97, 123), (0xC3, 0xE0)):
        kind[a:z] = LETTER
    kind[0x80:0xC0] = REST
    kind[0xE0:] = DENSE
    return kind


_KIND = _kinds()


def starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where windows open in normal text whose documents begin at ``ends``.

    A character opens one where it begins a document, where its kind isn't that
    of the one before, everywhere in scripts of three and four bytes (they may
    have no spaces, and their marks are among them), and everywhere far inside a
    run of one kind.  So a part of a text opens the windows it opens by itself,
    but for those of its first run where that goes on to the left.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _KIND[data[at]]
    fresh = np.ones(len(at), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    edge = np.searchsorted(at, ends)
    fresh[edge[edge < len(at)]] = True
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return at[(kind != GAP) & (fresh | (kind == DENSE) | (np.arange(len(at)) - run >= LONG_WORD))]


class Walk:
    """One random walk and the sampled steps of its tables."""

    def __init__(self, steps: int, kept: int, seed: int):
        rng = np.random.default_rng(seed)
        self.steps = steps
        self.move = rng.integers(0, 2, (steps, 256)).astype(np.intp)
        self.code = rng.integers(1, 1 << 32, (steps, 256), dtype=np.uint32)
        self.kept = np.zeros((TABLES, steps), bool)
        for t in range(TABLES):
            self.kept[t, rng.choice(steps, kept, replace=False)] = True

    def keys(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Key of each window in each table, (TABLES, windows).  ``data`` has ``steps`` spare bytes."""
        at = start.astype(np.intp)
        out = np.zeros((TABLES, len(at)), np.uint32)
        for j in range(self.steps):
            c = data[at]
            v = self.code[j][c]
            for t in range(TABLES):
                if self.kept[t, j]:
                    out[t] ^= v
            at += self.move[j][c]
        for t in range(TABLES):
            out[t] *= U(0x9E3779B1)
            out[t] ^= out[t] >> U(15)
            out[t] += U(t * 0x61C88647 & 0xFFFFFFFF)
        return out


def search(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of the pattern in the text, None beyond ``most`` edits.

    Both ends of the text are free; of equal places the first counts.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, row) for every row in lo[i] : hi[i]."""
    many = hi - lo
    i = np.repeat(np.arange(len(lo)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)


def apart(rows: np.ndarray) -> np.ndarray:
    """Distinct rows in order."""
    rows = rows[np.lexsort(rows.T)]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[fresh]


class Pieces:
    """Exact proposals of short items."""

    def __init__(self, items: list[tuple[int, bytes, int]]):
        """items: (item, normal text, most edits)."""
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, t, k in items:
            step = max(1, len(t) // (k + 1))
            size = min(PIECE, step)
            for p in range(0, min(step * (k + 1), len(t)), step):
                rows[size].append((int.from_bytes(t[p : p + size], "little"), n, p))
        self.tables = []
        for size in sorted(rows):
            code, n, p = zip(*rows[size], strict=True)
            order = np.argsort(np.array(code, np.uint64), kind="stable")
            keys = np.array(code, np.uint64)[order]
            f = np.zeros(1 << FILTER_BITS, bool)
            f[self._slot(keys)] = True
            self.tables.append((size, keys, np.array(n)[order], np.array(p)[order], f))

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def proposals(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of (item, document, about where it begins) of one run of normal text."""
        n = len(data)
        spare = np.concatenate([data, np.zeros(PIECE, np.uint8)])
        code, got = np.zeros(n, np.uint64), 0
        found = [np.zeros((0, 3), np.int64)]
        for size, keys, item, place, f in self.tables:
            for j in range(got, size):
                code |= spare[j : j + n].astype(np.uint64) << np.uint64(8 * j)
            got = size
            at = np.flatnonzero(f[self._slot(code)])
            i, row = spread(np.searchsorted(keys, code[at], "left"), np.searchsorted(keys, code[at], "right"))
            found.append(np.stack([item[row], np.searchsorted(ends, at[i], "right") - 1, at[i] - place[row]], axis=1))
        return apart(np.concatenate(found))


class Index:
    """Keys of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.ids, self.texts, self.most = [], [], []
        self.walks = [Walk(STEPS, KEPT, 11 + 2 * r) for r in range(REPEATS)]
        keys: list[list[np.ndarray]] = [[] for _ in self.walks]
        where: list[list[np.ndarray]] = [[] for _ in self.walks]
        short = []
        for item_id, text in items:
            data, _ = normal(np.frombuffer((text or "").encode(), np.uint8))
            data = np.frombuffer(data.tobytes().strip(), np.uint8)
            if not len(data):
                continue  # nothing that a text could hold
            n = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(data.tobytes())
            self.most.append(int(rate * len(data)))
            if len(data) < SHORT:
                short.append((n, self.texts[n], self.most[n]))
                continue
            start = starts(data, np.zeros(1, np.int64))
            start = start[start <= len(data) - STEPS]
            spare = np.concatenate([data, np.zeros(1, np.uint8)])
            pair = np.stack([np.full(len(start), n), start], axis=1)
            for w, walk in enumerate(self.walks):
                keys[w].append(walk.keys(spare, start).reshape(-1))
                where[w].append(np.concatenate([pair] * TABLES))
        self.pieces = Pieces(short)
        self.limit = np.array(self.most, np.int64)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.keys, self.where, self.filter = [], [], []
        for k in range(len(self.walks)):
            a = np.concatenate(keys[k]) if keys[k] else np.zeros(0, np.uint32)
            b = np.concatenate(where[k]) if where[k] else np.zeros((0, 2), np.int64)
            order = np.argsort(a, kind="stable")
            self.keys.append(a[order])
            self.where.append(b[order])
            f = np.zeros(1 << FILTER_BITS, bool)
            f[a >> U(32 - FILTER_BITS)] = True
            self.filter.append(f)

    def proposals(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of (item, document, about where it begins in units of CELL bytes) of one run of normal text, items of SHORT bytes or more."""
        found = [np.zeros((0, 3), np.int64)]
        start = starts(data, ends)
        spare = np.concatenate([data, np.zeros(STEPS + 1, np.uint8)])
        for k, walk in enumerate(self.walks):
            own = self.keys[k]
            if not len(own) or not len(start):
                continue
            for got in walk.keys(spare, start):
                hit = np.flatnonzero(self.filter[k][got >> U(32 - FILTER_BITS)])
                i, row = spread(np.searchsorted(own, got[hit], "left"), np.searchsorted(own, got[hit], "right"))
                at = start[hit[i]]
                n, q = self.where[k][row].T
                found.append(np.stack([n, np.searchsorted(ends, at, "right") - 1, (at - q) // CELL], axis=1))
        return apart(np.concatenate(found))

    def likely(self, data: np.ndarray, item: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """Whether the parts of each item could stand about its place with the allowed edits in all."""
        out = np.ones(len(item), bool)
        if len(item) < FEW:
            return out
        for k in range(0, len(item), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            edits = np.zeros(len(item[part]), np.int64)
            live = np.arange(len(edits))
            for begin in range(0, int(self.length[item[part]].max(initial=0)), 64):
                live = live[edits[live] <= self.limit[item[part][live]]]
                now = live[self.length[item[part][live]] > begin]
                if not len(now):
                    break
                edits[now] += self._part(data, item[part][now], begin, place[part][now] + begin, slack)
            out[part] = edits <= self.limit[item[part]]
        return out

    def _part(self, data: np.ndarray, item: np.ndarray, begin: int, place: np.ndarray, slack: int) -> np.ndarray:
        """Least edit distance of item[begin : begin + 64] near each place (64-bit words of ``search``)."""
        which, i = np.unique(item, return_inverse=True)
        width = np.minimum(64, self.length[which] - begin)
        row, at = spread(self.first[which] + begin, self.first[which] + begin + width)
        masks = np.zeros((len(which), 256), np.uint64)
        np.bitwise_or.at(masks, (row, self.flat[at]), np.uint64(1) << (at - self.first[which[row]] - begin).astype(np.uint64))
        width, most = width[i], self.limit[item]
        low = place - most
        top = np.uint64(1) << (width - 1).astype(np.uint64)
        pv, mv = np.full(len(i), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(i), np.uint64)
        score = width.copy()
        best = score.copy()
        for j in range(int((width + 2 * most).max(initial=0)) + slack):
            x = low + j
            eq = masks[i, data[np.clip(x, 0, len(data) - 1)]]
            eq[(x < 0) | (x >= len(data))] = 0
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            np.minimum(best, score, out=best)
            ph, mh = ph << np.uint64(1), mh << np.uint64(1)
            pv, mv = mh | ~(xv | ph), ph & xv
        return best


def leaks(index: Index, text: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, object, int, int, int]]:
    """(document, item id, first byte, past byte, edits) of each confirmed leak of a run."""
    data, at = normal(text)
    ends = np.searchsorted(at, off)
    # a boundary takes the place of the joint space of two documents
    raw = data.tobytes()
    best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    proposed = []
    for rows, size, slack in ((index.proposals(data, ends), CELL, CELL), (index.pieces.proposals(data, ends), 1, 0)):
        keep = index.likely(data, rows[:, 0], rows[:, 2] * size, slack)
        proposed += [(n, doc, place * size, slack) for n, doc, place in rows[keep].tolist()]
    for n, doc, place, slack in proposed:
        m, most = len(index.texts[n]), index.most[n]
        lo = max(int(ends[doc]), place - most)
        hi = min(int(ends[doc + 1]), place + slack + m + most)
        if hi - lo < m - most:
            continue
        got = search(index.texts[n], raw[lo:hi], most)
        if got is None:
            continue
        edits, end = got
        back = search(index.texts[n][::-1], raw[lo : lo + end][::-1], edits)
        begin = lo + end - (back[1] if back else m)
        key = (doc, n, (lo + end) // max(m // 2, 1))
        if key not in best or edits < best[key][0]:
            best[key] = (edits, begin, lo + end)
    seen: dict[tuple[int, int], int] = {}
    for (doc, n, _), (edits, begin, end) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1], x[1][2])):
        if (doc, n) in seen and begin < seen[doc, n]:
            continue
        seen[doc, n] = end
        yield doc, index.ids[n], int(at[begin] - off[doc]), int(at[end - 1] + 1 - off[doc]), edits


_held: tuple[str, Index] | None = None


def _index(key: str, part, rate: float) -> Index:
    """The index of a block of items, made once a worker process and block."""
    global _held
    if _held is None or _held[0] != key:
        _held = (key, Index(part.value, rate))
    return _held[1]


def _blocks(items: DataFrame, block: int) -> Iterator[tuple[str, object]]:
    """(key, broadcast list of (item_id, text)) of each block of items; a block comes to the driver at a time."""
    spark = items.sparkSession
    usable = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = usable.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_blocks = max(1, -(-size["n"] // block), -(-(size["b"] or 0) // BLOCK_BYTES))
    mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for k in range(n_blocks):
        part = [(r[0], r[1]) for r in usable.filter(mine == k).orderBy("item_id", "text").collect()]
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(part)


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK_ITEMS) -> DataFrame:
    """One row a leak: doc_id, item_id, start, stop (bytes of the text), edits.

    items: item_id and text.  An item leaks into a text that holds it with at
    most ``rate`` times its length edits, anywhere.  Null and empty texts hold
    nothing; null and empty items are passed over.  An item of under ten bytes is
    held where it stands unchanged, be it inside a word.
    """
    ship(docs.sparkSession)
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, stop long, edits int"

    def passed(key: str, part) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, part, rate)
            for batch in it:
                ids = batch.column(0)
                for lo, _, off, data in textbuf.runs(batch.column(1)):
                    rows = list(leaks(index, data, off))
                    if rows:
                        doc, item, start, stop, edits = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([lo + d for d in doc])), pa.array(item), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(edits, pa.int32())],
                            names=["doc_id", "item_id", "start", "stop", "edits"],
                        )

        return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)

    parts = [passed(*x) for x in _blocks(items, block)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK_ITEMS) -> DataFrame:
    """The rows whose text holds no item; all columns stay.

    A row is judged by its own text, whatever its id.  Rows pass through where they
    are: nothing is joined or shuffled.
    """
    ship(docs.sparkSession)

    def passed(rows: DataFrame, key: str, part) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, part, rate)
            for batch in it:
                own = batch.column(0)
                for lo, hi, off, data in textbuf.runs(own.field("text")):
                    held = np.zeros(hi - lo, bool)
                    held[[doc for doc, *_ in leaks(index, data, off)]] = True
                    yield pa.RecordBatch.from_arrays([own.slice(lo, hi - lo).filter(pa.array(~held))], names=["own"])

        own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own")
        return rows.select(own).mapInArrow(run, f"own {docs.select(own).schema['own'].dataType.simpleString()}").select(*[F.col(f"own.`{c}`") for c in docs.columns])

    for key, part in _blocks(items, block):
        docs = passed(docs, key, part)
    return docs
