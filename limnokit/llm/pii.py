"""Personal data found by expanding anchors.

An Aho-Corasick automaton runs once over each whole text and reports anchors:
at-signs, a plus before a digit, digits joined by a dot, digits in a row or
parted by one blank or hyphen, schemes (``https://``, ``mailto:``) and cues of
identifiers (``IBAN``, ``account no``, ``SSN``, ``passport``). A small local parser
per kind then walks from the anchor to the bounds of the span and validates it,
so no expression is tried at places without an anchor.

Base kinds, leftmost and without overlap within a kind:

* ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``: four runs of digits joined by dots, each at most 255
* ``card``: digits, each pair parted by at most one blank or hyphen; 12 to 19 that pass Luhn
* ``phone``: ``\\+[0-9][ ().0-9-]+[0-9]`` with 9 to 15 digits

Added by the anchors: ``url_login`` (user and password in an address), ``mailto``
(what follows the scheme, further and encoded addresses included), ``iban``
(after its cue; as long as its country's are, checked modulo 97) and ``account``
(identifier of 6 to 20 characters with at least 5 digits after a cue). A cue is a
whole word or words; an identifier ends with a whole group of characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.llm.batches import text_pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_login", "iban", "account", "mailto")
RANK = {kind: i for i, kind in enumerate(KINDS)}
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "postgres://", "mysql://", "redis://", "amqp://", "mongodb://")
CUES = ("iban", "account number", "account no", "acct", "ssn", "social security", "passport", "tax id", "kontonummer", "numéro de compte", "número de cuenta")
FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
)

_DIGITS = frozenset("0123456789")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE_TAIL = re.compile(r"[ ().0-9-]+")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@(?=[A-Za-z0-9\[])")
_MAILTO = re.compile(r"[^\s\"'<>]+")
_AFTER_CUE = re.compile(r"(?:\s*(?:(?:number|no|nr|is)\b\.?|[#:=]))*\s*")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN_PART = re.compile(r" ?[A-Z0-9]")
_FIRST_GROUP = re.compile(r"[A-Za-z0-9]*[0-9][A-Za-z0-9]*|[A-Z]{1,3}(?=[ -]?[0-9])")
_NEXT_GROUP = re.compile(r"[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*")
# Characters of an IBAN by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    digits = sorted(_DIGITS)
    out.add_word("@", ("email", 1))
    for a in digits:
        out.add_word("+" + a, ("phone", 2))
        for b in digits:
            out.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                out.add_word(a + gap + b, ("card", 2 + len(gap)))
    for word, kind in [*((x, "url_login") for x in SCHEMES), *((x, "cue") for x in CUES), ("mailto:", "mailto")]:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _ends_here(text: str, at: int) -> bool:
    return at >= len(text) or not text[at].isalnum()


def _iban(text: str, start: int) -> int | None:
    """End of the IBAN at ``start``: of its country's length, or for other countries of the greatest that holds."""
    if not _IBAN_HEAD.match(text, start):
        return None
    ends = [start + k for k in range(1, 5)]
    while len(ends) < 34 and (part := _IBAN_PART.match(text, ends[-1])):
        ends.append(part.end())
    known = IBAN_LENGTHS.get(text[start : start + 2])
    for length in (known,) if known else range(len(ends), 14, -1):
        if length <= len(ends) and _ends_here(text, ends[length - 1]) and _iban_holds(text[start : ends[length - 1]]):
            return ends[length - 1]
    return None


def _identifier(text: str, start: int) -> int | None:
    """End of 6 to 20 characters in whole groups, each of which but a short first one has a digit, with at least 5 digits in all."""
    found, group = None, _FIRST_GROUP.match(text, start)
    while group:
        taken = text[start : group.end()].replace(" ", "").replace("-", "")
        if len(taken) > 20:
            break
        if len(taken) >= 6 and sum(c in _DIGITS for c in taken) >= 5 and _ends_here(text, group.end()):
            found = group.end()
        group = _NEXT_GROUP.match(text, group.end()) or (_FIRST_GROUP.match(text, group.end()) if group.group().isalpha() else None)
    return found


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """Around the at-sign ``at``; nothing before ``free`` may be taken."""
    start = at
    while start > free and _LOCAL.match(text, start - 1, start):
        start -= 1
    host = _HOST.match(text, at + 1)
    return (start, host.end()) if start < at and host else None


def _ip(text: str, dot: int, free: int) -> tuple[int, int, bool] | None:
    """From the digits before the dot; the last value tells whether all parts are at most 255."""
    start = dot
    while start > free and text[start - 1] in _DIGITS:
        start -= 1
    at, parts = start, []
    while len(parts) < 4 and (run := _RUN.match(text, at)):
        parts.append(run.group())
        at = run.end()
        if len(parts) < 4:
            if text[at : at + 1] != ".":
                return None
            at += 1
    if len(parts) < 4:
        return None
    return start, at, all(len(x.lstrip("0")) <= 3 and int(x[-3:] if len(x) > 3 else x) <= 255 for x in parts)


def _account(text: str, cue: int, cue_end: int) -> tuple[str, int, int] | None:
    if cue > 0 and text[cue - 1].isalnum() or not _ends_here(text, cue_end):
        return None
    start = _AFTER_CUE.match(text, cue_end).end()
    if end := _iban(text, start):
        return "iban", start, end
    if end := _identifier(text, start):
        return "account", start, end
    return None


def _mailto(text: str, start: int) -> int | None:
    """End of the addresses after the scheme, without the punctuation of the sentence around them."""
    found = _MAILTO.match(text, start)
    addresses = found.group().rstrip(".,;:!?)]") if found else ""
    return start + len(addresses) if "@" in addresses or "%40" in addresses else None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as ``(start, end, kind)``, by start and then in order of ``KINDS``.

    Places count code points; ends are exclusive. A match that fails its check
    still uses up its characters for its kind, as a scan without retries does.
    """
    spans: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if kind == "email":
            if at >= free[kind] and (found := _email(text, at, free[kind])):
                spans.append((*found, kind))
                free[kind] = found[1]
        elif kind == "card":
            if at >= free[kind]:
                end = _CHAIN.match(text, at).end()
                free[kind] = end
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, end, kind))
        elif kind == "ip":
            if at >= free[kind] and (found := _ip(text, at + 1, free[kind])):
                free[kind] = found[1]
                if found[2]:
                    spans.append((found[0], found[1], kind))
        elif kind == "phone":
            tail = _PHONE_TAIL.match(text, at + 2)
            if tail:
                end = tail.end()
                while end > at + 2 and text[end - 1] not in _DIGITS:
                    end -= 1
                if end > at + 3 and 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    spans.append((at, end, kind))
        elif kind == "url_login":
            if at >= free[kind] and (m := _LOGIN.match(text, last + 1)):
                spans.append((at, m.end() - 1, kind))
                free[kind] = m.end()
        elif kind == "mailto":
            if at >= free[kind] and (end := _mailto(text, last + 1)):
                spans.append((last + 1, end, kind))
                free[kind] = end
        elif found := _account(text, at, last + 1):
            if found[1] >= free[found[0]]:
                spans.append((found[1], found[2], found[0]))
                free[found[0]] = found[2]
    spans.sort(key=lambda x: (x[0], RANK[x[2]]))
    return spans


def _written(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row of ``docs`` (``doc_id``, ``text``).

    ``base_sha256`` digests the base spans alone. A null or empty text has no
    spans. Rows are searched one by one, so repeated rows and null ids give a
    row each; other columns are ignored.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_pieces(batches):
            found = [find_spans(x) for x in texts.to_pylist()]
            base = [[x for x in spans if x[2] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(x[2] == kind for x in spans) for spans in base], pa.int64()) for kind in BASE_KINDS]
            digests = [hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base]
            yield pa.record_batch(
                [
                    rows.column("doc_id"),
                    *counts,
                    pa.array(digests, pa.string()),
                    pa.array(map(_written, found), pa.string()),
                    pa.array(map(len, found), pa.int64()),
                ],
                [c.strip().split()[0] for c in FOUND.split(",")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, FOUND)


def mask(text: str) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping ones the first and longest stands."""
    out, done = [], 0
    for start, end, kind in sorted(find_spans(text), key=lambda x: (x[0], -x[1], RANK[x[2]])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
        elif end > done:  # an overlapping span that reaches further is covered as well
            done = end
    return "".join(out) + text[done:] if out else text


def mask_personal_data(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span of ``column`` masked; rows, columns and null texts stay as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in text_pieces(batches, column):
            at = rows.schema.get_field_index(column)
            found = pa.array([x if x is None else mask(x) for x in rows.column(at).to_pylist()], rows.column(at).type)
            yield rows.set_column(at, rows.schema.field(at), found)

    return docs.mapInArrow(run, docs.schema)
