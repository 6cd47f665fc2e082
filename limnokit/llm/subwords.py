"""Exact token ids of whole texts by public tokenizers, from ids kept for short units.

A unit is a piece of text at whose bounds the tokenizer always cuts: a word with
the white space before it (byte-level vocabularies) or a bare word (vocabularies
that drop white space). So the ids of a text are the ids of its units joined.
Units are found and hashed in the raw bytes of a whole batch; a worker keeps the
ids of those it has met in sorted arrays, about 20 bytes each. A new unit is cut
into pre-tokens and the library's own model encodes them. Units with letters
beyond Latin-1, and whole texts with special strings or Unicode white space, go
to the library as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from limnokit.llm.batches import raw_text
from limnokit.llm.words import WORD_BYTES, span_hashes, word_bounds

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units and pre-tokens a worker keeps; when there are more it starts anew.
KEPT_UNITS, KEPT_PIECES = 1_500_000, 150_000

_PLAIN = re.compile("[\n ]?[!-~\xa1-\xff]+")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The pre-tokens of the two public vocabularies, stated for plain units.
_SPACED = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\n {_L}{_N}]+|\n")
_PARTED = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+")


def _byte_letters() -> dict[int, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown, strict=True)) | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _pairs(raw: np.ndarray, first: int, second: int) -> np.ndarray:
    return np.flatnonzero((raw[:-1] == first) & (raw[1:] == second))


def uncertain_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold ``<|`` or white space beyond ASCII, where units could be cut wrongly."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(raw) < 2:
        return out
    found = [_pairs(raw, ord("<"), ord("|"))]
    lead = np.flatnonzero(np.isin(raw[:-1], (0xC2, 0xE1, 0xE2, 0xE3)))
    second = raw[lead + 1]
    third = raw[np.minimum(lead + 2, len(raw) - 1)]
    blank = (raw[lead] == 0xC2) & np.isin(second, (0x85, 0xA0))  # U+0085, U+00A0
    blank |= (raw[lead] == 0xE1) & np.isin(second, (0x9A, 0xA0))  # U+1680, U+180E and neighbours
    blank |= (raw[lead] == 0xE2) & (second == 0x80) & ((third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)))
    blank |= (raw[lead] == 0xE2) & (second == 0x81) & (third == 0x9F)
    blank |= (raw[lead] == 0xE3) & (second == 0x80) & (third == 0x80)
    found.append(lead[blank])
    out[np.searchsorted(offsets, np.concatenate(found), side="right") - 1] = True
    return out


class KeptUnits:
    """Hash of a unit -> place and number of its ids, in a few sorted arrays of growing size."""

    def __init__(self, width: np.dtype, limit: int) -> None:
        self.width, self.limit = width, limit
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.used = 0, 0
        self.ids = np.zeros(1 << 16, self.width)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place (-1: not kept) and number of ids of each of the sorted ``keys``."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, at, n in self.levels:
            i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[i] == keys
            place[hit], count[hit] = at[i[hit]], n[i[hit]]
        return place, count

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Keep the ids of new ``keys`` (sorted)."""
        item = self.width.itemsize
        n = np.array([len(x) // item for x in ids], np.int64)
        at = self.used + np.cumsum(n) - n
        joined = np.frombuffer(b"".join(ids), self.width)
        if self.used + len(joined) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(joined)), self.width)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(joined)] = joined
        self.used += len(joined)
        self.size += len(keys)
        level = (keys, at, n.astype(np.int32))
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(x[order] for x in both)
        self.levels.append(level)


@dataclass
class Encoded:
    """Ids of a batch of texts: those of text ``i`` are ``ids[bound[i]:bound[i + 1]]``."""

    ids: np.ndarray
    bound: np.ndarray


class CachedTokenizer:
    """Token ids of texts, equal to ``encode(text, add_special_tokens=False)``.

    ``spaced`` tells whether blanks belong to the tokens (byte-level
    vocabularies) or only part words (lower-casing word vocabularies).
    """

    def __init__(self, path: str, spaced: bool, units: int = KEPT_UNITS, pieces: int = KEPT_PIECES) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced, self.most_pieces = spaced, pieces
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kept = KeptUnits(np.dtype("<u2" if self.code == "H" else "<u4"), units)
        self.pieces: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        return [array(self.code, x.ids).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = array(self.code, [x.id for x in self.model.tokenize(letters)]).tobytes()
        if len(self.pieces) >= self.most_pieces:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units by themselves."""
        out, odd = [], []
        get, fresh = self.pieces.get, self._piece
        for unit in units:
            if _PLAIN.fullmatch(unit):
                cut = _SPACED.findall(unit) if self.spaced else _PARTED.findall(unit.lower())
                out.append(b"".join([get(x) or fresh(x) for x in cut]))
            else:
                odd.append(len(out))
                out.append(b"")
        for i, ids in zip(odd, self.encode_whole([units[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _unit_bounds(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each unit."""
        start, end, first = word_bounds(WORD_BYTES["space"][raw], offsets)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if not self.spaced:
            return start, end, doc
        # every unit reaches back to the end of the one before; what is left at the end of a text is a unit too
        last = np.where(np.diff(first) > 0, end[np.maximum(first[1:], 1) - 1] if len(end) else 0, offsets[:-1])
        tail = np.flatnonzero(offsets[1:] > last)
        ends = np.concatenate([end, offsets[1:][tail]])
        docs = np.concatenate([doc, tail])
        order = np.argsort(ends, kind="stable")
        ends, docs = ends[order], docs[order]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return np.maximum(starts, offsets[docs]), ends, docs

    def _read(self, texts: pa.StringArray) -> tuple[np.ndarray, ...]:
        """Raw bytes, start, end and text of the units, and which texts must be encoded whole."""
        raw, offsets = raw_text(texts)
        whole = uncertain_texts(raw, offsets)
        start, end, doc = self._unit_bounds(raw, offsets)
        if whole.any():
            sure = ~whole[doc]
            start, end, doc = start[sure], end[sure], doc[sure]
        return raw, start, end, doc, whole

    def _keep(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of units with the sorted, distinct ``keys``; encodes those not met before."""
        place, count = self.kept.find(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            if self.kept.size + len(missing) > self.kept.limit:
                self.kept.clear()
                missing = np.arange(len(keys))
            spelt = [raw[a:b].tobytes().decode() for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
            self.kept.add(keys[missing], self.encode_units(spelt))
            place, count = self.kept.find(keys)
        return place, count

    def counts(self, texts: pa.StringArray, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Number of tokens of each text (no nulls).

        ``common`` holds sorted hashes of units and their numbers of tokens:
        the first tier, looked at before the units this worker keeps.
        """
        raw, start, end, doc, whole = self._read(texts)
        keys, sample, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        count, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if common is not None and len(common[0]):
            i = np.minimum(np.searchsorted(common[0], keys), len(common[0]) - 1)
            known = common[0][i] == keys
            count[known] = common[1][i[known]]
        miss = sample[~known]
        count[~known] = self._keep(raw, start[miss], end[miss], keys[~known])[1]
        out = np.bincount(doc, count[which], minlength=len(texts)).astype(np.int64)
        rows = np.flatnonzero(whole)
        out[rows] = [len(x) // self.kept.width.itemsize for x in self.encode_whole([texts[int(i)].as_py() for i in rows])]
        return out

    def unit_counts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units of the texts: hash, number of tokens, occurrences."""
        raw, start, end, _, _ = self._read(texts)
        keys, sample, seen = np.unique(span_hashes(raw, start, end), return_index=True, return_counts=True)
        return keys, self._keep(raw, start[sample], end[sample], keys)[1], seen

    def encode(self, texts: pa.StringArray) -> Encoded:
        """Ids of all texts (no nulls)."""
        raw, start, end, doc, whole = self._read(texts)
        keys, sample, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        place, count = (x[which] for x in self._keep(raw, start[sample], end[sample], keys))
        pool = self.kept.ids
        if whole.any():
            rows = np.flatnonzero(whole)
            found = self.encode_whole([texts[int(i)].as_py() for i in rows])
            sizes = np.array([len(x) // pool.itemsize for x in found], np.int64)
            places = len(pool) + np.cumsum(sizes) - sizes
            pool = np.concatenate([pool, np.frombuffer(b"".join(found), pool.dtype)])
            order = np.argsort(np.concatenate([doc, rows]), kind="stable")
            doc = np.concatenate([doc, rows])[order]
            place, count = np.concatenate([place, places])[order], np.concatenate([count, sizes])[order]
        done = np.cumsum(count)
        take = np.arange(int(done[-1]) if len(done) else 0) + np.repeat(place - done + count, count)
        per_text = np.bincount(doc, count, minlength=len(texts)).astype(np.int64)
        return Encoded(pool[take], np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64))


_OPEN: dict[tuple, CachedTokenizer] = {}


def cached_tokenizer(path: str, spaced: bool) -> CachedTokenizer:
    """One per worker process and vocabulary, kept between tasks."""
    key = (path, spaced)
    if key not in _OPEN:
        _OPEN[key] = CachedTokenizer(path, spaced)
    return _OPEN[key]
