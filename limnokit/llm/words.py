"""Words and word n-grams of a batch of texts as numpy arrays, found in the raw UTF-8 bytes.

Nothing loops over words: word bounds come from a table of 256 byte classes,
hashes from prefix sums of a polynomial over the ring of 64-bit integers, whose
base is odd and so can be divided out again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from limnokit.llm.batches import raw_text

_U = np.uint64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True

#: Byte classes by the name of a word definition: runs of anything but white
#: space, or runs of a-z, 0-9 and all beyond ASCII (after lower-casing).
WORD_BYTES = {"space": ~_SPACE, "alnum": _ALNUM}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown as they are asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.full(size, self.base, _U)
            self.down = np.full(size, self.inverse, _U)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F)]
_LETTERS = [mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93 + 2 * k)) for k in (1, 2)]


def _prefix(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers, out=sums[1:])
    return sums


def span_hashes(seen: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = _POWERS[family](len(seen) + 1)
    sums = _prefix(_LETTERS[family][seen], up[: len(seen)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0x2545F4914F6CDD1D))


def word_bounds(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs in the mask ``word`` within each text, and the first run of each text."""
    opens, closes = word.copy(), word.copy()
    if len(word):
        cut = offsets[(offsets > 0) & (offsets < len(word))]
        before, after = word[:-1].copy(), word[1:].copy()
        before[cut - 1] = after[cut - 1] = False
        opens[1:] &= ~before
        closes[:-1] &= ~after
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


@dataclass
class WordTable:
    """All words of ``n_docs`` texts, in order.

    ``start`` and ``end`` are byte places in ``raw`` (unchanged bytes), ``doc``
    the text of each word, ``first`` the first word of each text and, at the
    end, the number of words.
    """

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    seen: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of every word; the two families are independent."""
        return span_hashes(self.seen, self.start, self.end, family)

    def grams(self, n: int, hashes: np.ndarray | None = None, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all n-grams that stay within a text, and their hashes."""
        hashes = self.hashes(family) if hashes is None else hashes
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        up, down = _POWERS[family](len(hashes) + 1)
        sums = _prefix(hashes, up[: len(hashes)])
        return at, mix((sums[at + n] - sums[at]) * down[at] + _U(n))

    def words(self, low: int, high: int) -> bytes:
        """The words from ``low`` to before ``high`` as they were compared, joined by a space."""
        return b" ".join(self.seen[self.start[i] : self.end[i]].tobytes() for i in range(low, high))


def word_table(texts: pa.StringArray, kind: str = "space", lower: bool = False) -> WordTable:
    """The words of ``texts`` (no nulls) under one of ``WORD_BYTES``; ``lower`` changes A-Z only."""
    raw, offsets = raw_text(texts)
    seen = _LOWER[raw] if lower else raw
    start, end, first = word_bounds(WORD_BYTES[kind][seen], offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return WordTable(raw, start, end, doc, first, seen)
