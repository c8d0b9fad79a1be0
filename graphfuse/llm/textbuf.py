"""Whole-batch text kernels: Arrow string buffers seen as NumPy byte arrays.

A Spark Arrow batch holds all its texts in one contiguous UTF-8 buffer.  The
kernels below find words and fingerprint them over that buffer at once, so the
cost is a few vector passes a byte and no Python object is made per word.
Memory is bounded by cutting a batch into runs of documents of ``RUN_BYTES``
(one longer document makes a run of its own).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19

_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_BINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser (xor-shift-multiply) over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(32))
        h = h * _U(0xD6E8FEB86659FD93)
        h = h ^ (h >> _U(32))
        h = h * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _B)
BYTE_LOWER = BYTE[LOWER]

#: The second fingerprint works modulo this prime; a polynomial modulo 2**64 alone has strings that always collide.
PRIME = (1 << 31) - 1
_B2 = 1_220_703_125
_byte2 = mix(np.arange(1001, 1257, dtype=np.uint64)) % _U(PRIME)
_byte2_lower = _byte2[LOWER]


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo PRIME and below 2**32, for x below 2**63."""
    return (x & _U(PRIME)) + (x >> _U(31))


class _Powers:
    """Powers of a base by a table of LOW of them and one of every LOW-th, so that long texts need no long tables."""

    LOW = 1 << 16

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus = base, modulus
        self.low = self._table(base, self.LOW)
        self.high = np.ones(1, np.uint64)

    def _table(self, base: int, size: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        have = 1
        while have < size:
            more = min(have, size - have)
            out[have : have + more] = self._times(out[:more], _U(pow(base, have, self.modulus)))
            have += more
        return out

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return a * b if self.modulus == 1 << 64 else a * b % _U(PRIME)

    def block(self, k: int) -> np.ndarray:
        """The powers k * LOW to (k + 1) * LOW."""
        if not k:
            return self.low
        self._reach(k)
        return self._times(self.low, self.high[k])

    def at(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.uint64)
        top = int(i.max()) >> 16
        if not top:
            return self.low[i]
        self._reach(top)
        return self._times(self.low[i & (self.LOW - 1)], self.high[i >> 16])

    def _reach(self, k: int) -> None:
        if len(self.high) <= k:
            self.high = self._table(pow(self.base, self.LOW, self.modulus), max(k + 1, 64))


_POW, _INV = (_Powers(b, 1 << 64) for b in (0x9E3779B97F4A7C15, int(_BINV)))
_POW2, _INV2 = (_Powers(b, PRIME) for b in (_B2, pow(_B2, -1, PRIME)))


def prefix(data: np.ndarray, table: np.ndarray = BYTE, sure: bool = True) -> np.ndarray:
    """C with C[..., i] the polynomial fingerprints of data[:i]; ``sure`` has two rows, the second modulo PRIME.

    One row is enough for strings under a thousand bytes.
    """
    n = len(data)
    c = np.zeros((2 if sure else 1, n + 1), np.uint64)
    table2 = _byte2_lower if table is BYTE_LOWER else _byte2
    with np.errstate(over="ignore"):
        for k, lo in enumerate(range(0, n, _Powers.LOW)):
            part = data[lo : lo + _Powers.LOW]
            own = slice(lo + 1, lo + 1 + len(part))
            np.cumsum(table[part] * _POW.block(k)[: len(part)], out=c[0, own])
            c[0, own] += c[0, lo]
            if sure:
                np.cumsum(_fold(table2[part] * _POW2.block(k)[: len(part)]), out=c[1, own])
                c[1, own] += c[1, lo]
    return c if sure else c[0]


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Fingerprints of data[s:e], equal for equal bytes wherever they stand."""
    one = c if c.ndim == 1 else c[0]
    with np.errstate(over="ignore"):
        h = mix((one[e] - one[s]) * _INV.at(s) + (e - s).astype(np.uint64) * _U(0xA24BAED4963EE407))
        if c.ndim == 1:
            return h
        two = (c[1][e] - c[1][s]) % _U(PRIME) * _INV2.at(s) % _U(PRIME)
        return mix(h ^ two * _U(0x9FB21C651E98DF25))


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A batch function whose worker gives free memory back at its end; workers outlive their tasks."""

    @functools.wraps(f)
    def run(*args, **kw) -> Iterator[pa.RecordBatch]:
        yield from f(*args, **kw)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1, from 0) and bytes of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, buf = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return o - o[0], data[o[0] : o[-1]]


def runs(col: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, offsets, bytes) for runs of documents of about ``most`` bytes."""
    most = most or RUN_BYTES
    off, data = utf8(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        o = off[lo : hi + 1]
        yield lo, hi, o - o[0], data[o[0] : o[-1]]
        lo = hi


def lower_latin(data: np.ndarray) -> np.ndarray:
    """The bytes with accented Latin-1 capitals lowered; they are 0xC3 and 0x80 to 0x9E."""
    if not len(data):
        return data
    cap = np.zeros(len(data), bool)
    cap[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + cap.astype(np.uint8) * np.uint8(0x20)


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and first word of each document.

    Words never cross documents; the third array has one entry more than there
    are documents.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~WS[data]
    first = np.empty(n + 1, bool)  # a break stands before position i
    first[0] = first[n] = True
    np.logical_not(ink[:-1], out=first[1:n])
    last = np.empty(n, bool)
    last[n - 1] = True
    np.logical_not(ink[1:], out=last[: n - 1])
    cut = off[(off > 0) & (off < n)]
    first[cut] = True
    last[cut - 1] = True
    s = np.flatnonzero(ink & first[:n])
    e = np.flatnonzero(ink & last) + 1
    return s, e, np.searchsorted(s, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of all documents and where each document's begin.

    h: word hashes; first: first word of each document (n + 1).  A document of
    1 to k-1 words has one shingle, its whole sequence; one without words none.
    """
    n_words = np.diff(first)
    size = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    start = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    out = np.empty(start[-1], np.uint64)
    odd = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    if k > len(odd):
        raise ValueError(f"k is at most {len(odd)}")
    with np.errstate(over="ignore"):
        if len(h) >= k:
            m = len(h) - k + 1
            full = h[:m] * odd[0]
            for j in range(1, k):
                full += h[j : j + m] * odd[j]
            keep = np.zeros(len(h) + 1, np.int8)
            big = n_words >= k
            np.add.at(keep, first[:-1][big], 1)
            np.add.at(keep, first[1:][big] - k + 1, -1)
            out[np.repeat(n_words >= k, size)] = mix(full[np.cumsum(keep[:m]).astype(bool)])
        for d in np.flatnonzero((n_words > 0) & (n_words < k)):
            x = _U(int(n_words[d]))
            for j in range(n_words[d]):
                x = x * odd[6] + h[first[d] + j] * odd[j]
            out[start[d]] = mix(np.array([x], np.uint64))[0]
    return out, start
