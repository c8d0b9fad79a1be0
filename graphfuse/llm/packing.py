"""Hierarchical multi-length packing of token sequences.

Documents are routed to the shortest of several context sizes (tiers) that
holds them; whole windows of the longest size are cut from longer ones first.
Tiers are packed from the longest to the shortest: a window opens with the
longest document of its tier, its gap is filled with the longest documents of
shorter tiers that fit, and what gap is left is closed by cutting one of them.
The rest of a cut document goes back to the tier of its new length.  What can't
fill a window waits for the next block of documents, and at the end of a
partition is laid out in windows of falling powers of two, which need no
padding.  Sequences are dealt to step groups of equal token counts, heaviest
first, so that each optimiser step sees the same load whatever its lengths.

Every partition packs by itself and streams, holding one block: no shuffle, and
a lost task packs the same rows again.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .cluster import ship
from .tokens import WordTokens, vocabulary

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a block of documents that are packed together.
BLOCK_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 16

#: A piece: (length, document key, start in the document).
Piece = tuple[int, int, int]


class Packer:
    """Windows of one partition.  ``emit(tier, pieces)`` gets every finished window."""

    def __init__(self, tiers: tuple[int, ...], emit: Callable[[int, list[Piece]], None]):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers are rising powers of two")
        self.tiers, self.emit = tiers, emit
        self.pool: dict[int, list[Piece]] = {t: [] for t in tiers}

    def add(self, key: int, n: int) -> None:
        top, start = self.tiers[-1], 0
        while n - start >= top:
            self.emit(top, [(top, key, start)])
            start += top
        if n > start:
            self._route((n - start, key, start))

    def _route(self, piece: Piece) -> None:
        insort(self.pool[next(t for t in self.tiers if piece[0] <= t)], piece)

    def _fit(self, gap: int, below: int) -> Piece | None:
        """The longest piece of the tiers up to ``below`` that fits the gap."""
        for t in reversed(self.tiers[: below + 1]):
            i = bisect_right(self.pool[t], (gap, float("inf"), 0))
            if i:
                return self.pool[t].pop(i - 1)
        return None

    def _shortest(self, below: int) -> Piece | None:
        for t in self.tiers[: below + 1]:
            if self.pool[t]:
                return self.pool[t].pop(0)
        return None

    def pack(self) -> None:
        """Fill windows until what is left of a tier and below it can't fill one."""
        for k in range(len(self.tiers) - 1, -1, -1):
            t = self.tiers[k]
            left = sum(p[0] for x in self.tiers[: k + 1] for p in self.pool[x])
            while self.pool[t] and left >= t:
                window = [self.pool[t].pop()]
                gap = t - window[0][0]
                while gap:
                    piece = self._fit(gap, k)
                    if piece is None:
                        n, key, start = self._shortest(k)
                        piece = (gap, key, start)
                        self._route((n - gap, key, start + gap))
                    window.append(piece)
                    gap -= piece[0]
                self.emit(t, window)
                left -= t

    def finish(self) -> None:
        """Lay out the rest in windows of falling powers of two."""
        self.pack()
        rest = [p for t in reversed(self.tiers) for p in reversed(self.pool[t])]
        self.pool = {t: [] for t in self.tiers}
        total = sum(p[0] for p in rest)
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                n, key, start = rest.pop(0)
                window.append((min(n, gap), key, start))
                if n > gap:
                    rest.insert(0, (n - gap, key, start + gap))
                gap -= window[-1][0]
            self.emit(size, window)
            total -= size


class _Steps:
    """Deals windows to groups of about STEP_TOKENS, always to the lightest open group."""

    def __init__(self, size: int, most: int, at_once: int = 8):
        self.room, self.open, self.next = max(size, most), [], 0
        self.at_once = at_once

    def deal(self, n: int) -> int:
        if len(self.open) < self.at_once or self.open[0][0] + n > self.room:
            if len(self.open) >= self.at_once:
                heapq.heappop(self.open)
            heapq.heappush(self.open, (n, self.next))
            self.next += 1
            return self.next - 1
        load, g = heapq.heappop(self.open)
        heapq.heappush(self.open, (load + n, g))
        return g


def pack_batches(it: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = WordTokens.of(path)
    base = TaskContext.get().partitionId() << 40
    held: dict[int, tuple[object, np.ndarray]] = {}  # ids of documents with pieces still to place
    owed: dict[int, int] = {}
    done: list[tuple[int, list[Piece]]] = []
    packer = Packer(tiers, lambda tier, window: done.append((tier, window)))
    steps = _Steps(STEP_TOKENS, tiers[-1])
    n_seq = n_doc = 0
    id_type = None

    def flush() -> pa.RecordBatch:
        nonlocal n_seq
        cols: list[list] = [[] for _ in range(10)]
        done.sort(key=lambda x: -x[0])
        for tier, window in done:
            step, at = base + steps.deal(tier), 0
            for n, key, start in window:
                doc_id, ids = held[key]
                piece = ids[start : start + n]
                row = (doc_id, start, n, zlib.crc32(piece), len(ids), base + n_seq, at, tier, step, piece if with_ids else None)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
                at += n
                owed[key] -= n
                if not owed[key]:
                    del held[key], owed[key]
            n_seq += 1
        done.clear()
        out = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int64())]
        if with_ids:
            out.append(pa.array([x.astype(np.int32) for x in cols[9]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(out, names=NAMES[: len(out)])

    waiting = 0
    for batch in it:
        id_type = batch.schema.field(0).type
        doc_ids = batch.column(0).to_pylist()
        for lo, _, off, data in textbuf.runs(batch.column(1)):
            ids, start = tokens.encode(off, data, end)
            for i in range(len(start) - 1):
                own = ids[start[i] : start[i + 1]].astype("<u4")
                held[n_doc], owed[n_doc] = (doc_ids[lo + i], own), len(own)
                packer.add(n_doc, len(own))
                n_doc += 1
            waiting += len(ids)
            if waiting >= BLOCK_TOKENS:
                packer.pack()
                waiting = 0
                yield flush()
    if id_type is not None:
        packer.finish()
        yield flush()


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, end: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of token sequences of at most tiers[-1] ids.

    docs: doc_id and text; null text is empty, and an empty text still has its
    end id.  One row a piece: doc_id, start, length, ids_crc32 (of the ids as
    little-endian 32-bit words), doc_tokens, sequence_id, offset (gapless in the
    sequence), tier (length of the sequence's window), step_group; with_ids adds
    ids.  Each id of each row of docs lies in exactly one piece.
    """
    ship(docs.sparkSession)
    where = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", F.col("text")).mapInArrow(lambda it: pack_batches(it, where, tiers, end, with_ids), schema)
