"""Plain Python versions of what the corpus queries return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda m, d: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 9 <= len(d) <= 15,
            }[kind](m, digits)
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[2])))


def personal_data(rows):
    out = []
    for doc_id, text in rows:
        spans = base_spans(text)
        counts = [sum(x[2] == k for x in spans) for k in BASE]
        out.append((doc_id, *counts, sha(",".join(f"{k}:{a}:{b}" for a, b, k in spans))))
    return out


def contamination(rows, items):
    windows, sizes = defaultdict(set), set()
    for item_id, text in items:
        words = ALNUM.findall(ascii_lower(text or ""))
        size = min(10, len(words))
        if size:
            sizes.add(size)
            for i in range(len(words) - size + 1):
                windows[tuple(words[i : i + size])].add(str(item_id))
    out = []
    for doc_id, text in rows:
        words = ALNUM.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= ids
        out.append((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    words = SPACED.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near_groups(rows, n: int, percent: int) -> list[list[int]]:
    """Indices of ``rows`` by group; an empty set is a group of its own."""
    sets = [shingles(text, n) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(k)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return list(groups.values())


def near_duplicates(rows, n: int = 3, percent: int = 85):
    out = [None] * len(rows)
    for group in near_groups(rows, n, percent):
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        least = min(ids) if ids else None
        for i in group:
            out[i] = (rows[i][0], len(shingles(rows[i][1], n)), least, rows[i][0] == least if least is not None else True)
    return out


def repeats(rows, window: int = 35):
    words = [SPACED.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def quality(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        w = SPACED.findall(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))
        out.append((doc_id, *counts, len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    return out
