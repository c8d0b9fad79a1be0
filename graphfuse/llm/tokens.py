"""Token ids of whole text batches, one lookup a pre-token.

The vocabulary's pre-tokeniser drops white space and cuts words into runs of
letters, single digits and runs of other marks, and no token crosses a cut.  For
words of ASCII and Latin-1 letters, digits and plain marks these pieces are
found here over the whole buffer at once; any other word stays whole.  Each
distinct piece is given to the tokeniser once and its ids are kept.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np

from . import textbuf

#: Pieces kept by a worker before its store starts anew.
STORE = 1 << 20

LETTER, DIGIT, MARK, ODD = 1, 2, 3, 4

_CLASS = np.full(256, ODD, np.uint8)
_CLASS[33:127] = MARK
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[ord("'")] = ODD  # contractions have rules of their own
_CLASS[textbuf.WS] = 0


def pieces(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, whether it is a whole odd word, and first piece of each document."""
    s, e, first = textbuf.words(off, data)
    if not len(s):
        return s, e, np.zeros(0, bool), first
    cls = _CLASS[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[pair + 1]
    # letters of U+00C0 to U+00FF, all but the signs of multiplication and division
    pair = pair[(follow >= 0x80) & (follow < 0xC0) & (follow != 0x97) & (follow != 0xB7)]
    cls[pair] = cls[pair + 1] = LETTER
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    cls[special] = ODD
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum(cls == ODD, out=odd[1:])
    strange = odd[e] > odd[s]
    opens = np.zeros(len(data), bool)
    opens[s] = True
    cut = cls == DIGIT
    cut[1:] |= cls[1:] != cls[:-1]
    cut &= cls > 0
    begin = np.flatnonzero(cut | opens)
    word = np.searchsorted(s, begin, "right") - 1
    keep = opens[begin] | ~strange[word]
    begin, word = begin[keep], word[keep]
    end = np.minimum(np.append(begin[1:], len(data)), e[word])
    return begin, end, strange[word], np.searchsorted(begin, off)


class WordTokens:
    """Ids of texts under a word-level vocabulary file; one a worker process."""

    _open: dict[str, "WordTokens"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        #: Ids that end a pre-token, where the vocabulary marks them.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._clear()

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _clear(self) -> None:
        self.row: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _store(self, keys: list[int], flat: np.ndarray, n: np.ndarray) -> None:
        r, u = len(self.row), self.used
        self.ids = self._grown(self.ids, u + len(flat))
        self.ids[u : u + len(flat)] = flat
        self.begin, self.size = self._grown(self.begin, r + len(n)), self._grown(self.size, r + len(n))
        self.begin[r : r + len(n)] = u + np.cumsum(n) - n
        self.size[r : r + len(n)] = n
        self.used = u + len(flat)
        self.row.update(zip(keys, range(r, r + len(keys)), strict=True))

    def _learn(self, keys: list[int], texts: list[str], odd: bool) -> None:
        if not odd and self.ends.any():
            # pieces of one pre-token each: one text of all, cut where a token ends a word
            flat = np.array(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(self.ends[flat])
            if len(at) == len(keys):
                self._store(keys, flat, np.diff(at, prepend=-1))
                return
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self._store(keys, np.fromiter((i for x in got for i in x), np.uint32, int(n.sum())), n)

    def encode(self, off: np.ndarray, data: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of documents, and where each document's begin (n + 1).

        end: an id put after each document.
        """
        if len(self.row) > STORE:
            self._clear()
        s, e, odd, first = pieces(off, data)
        h = textbuf.span_hash(textbuf.prefix(textbuf.lower_latin(data), textbuf.BYTE_LOWER), s, e)
        if odd.any():  # special tokens know upper case from lower
            at = np.flatnonzero(odd)
            h[at] = ~textbuf.span_hash(textbuf.prefix(data), s[at], e[at])
        key, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = key.tolist()
        rows = np.fromiter(map(self.row.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = data.tobytes()
            for strange in (False, True):
                own = new[odd[at[new]] == strange]
                if len(own):
                    self._learn([keys[i] for i in own], [raw[s[j] : e[j]].decode("utf-8", "replace") for j in at[own]], strange)
            rows[new] = [self.row[keys[i]] for i in new]
        word_row = rows[inverse]
        size = self.size[word_row]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(self.begin[word_row] - total[:-1], size) + np.arange(total[-1])]
        start = total[first]
        if end is not None:
            n = len(off) - 1
            out = np.full(len(ids) + n, end, np.uint32)
            keep = np.ones(len(out), bool)
            keep[start[1:] + np.arange(n)] = False
            out[keep] = ids
            return out, start + np.arange(n + 1)
        return ids, start


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
