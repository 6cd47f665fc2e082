"""What the style sheets of a page say of display and visibility, for selectors of one compound.

A selector is a tag, classes and ids in one piece (``p``, ``.note``, ``div#menu.wide``
or ``*``); the most specific rule counts, then the later one. Selectors with
combinators, attributes or pseudo-classes, and rules for other media than the
screen, are left out.
"""

from __future__ import annotations

import re

_SHEET = re.compile(r"<!--(?:.*?-->|.*)|<style\b([^>]*)>(.*?)(?:</style|\Z)", re.S | re.I)
_REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"\*|(?=[\w.#])([a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
_SAID = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Above any specificity of selectors.
INLINE, IMPORTANT = 1 << 40, 1 << 41


def declarations(text: str) -> list[tuple[str, str, int]]:
    """``(property, value, weight)`` of each display and visibility in a list of declarations."""
    return [(p.lower(), v.lower(), IMPORTANT if loud else 0) for p, v, loud in _SAID.findall(text)] if ":" in text else []


def _blocks(sheet: str) -> list[tuple[str, str]]:
    """Selector lists and declarations, those inside ``@media`` for the screen included."""
    out, open_, start = [], [], 0
    for mark in re.finditer(r"[{}]", sheet):
        head = sheet[start : mark.start()]
        start = mark.end()
        if mark.group() == "{":
            open_.append(head.rpartition(";")[2].strip())
        elif open_:
            head_of = open_.pop()
            outer = [h.lower() for h in open_]
            if not head_of.startswith("@") and all(h.startswith("@media") and ("print" not in h or "screen" in h) for h in outer):
                out.append((head_of, head))
    return out


class Rules:
    """The rules of all sheets of a page, found by id, class or tag."""

    def __init__(self, html: str) -> None:
        self.by: dict[str, list[tuple]] = {}
        for found in _SHEET.finditer(html) if "<style" in html.lower() else ():
            if found.group(2) is None or "print" in found.group(1).lower():
                continue
            for selectors, body in _blocks(_REMARK.sub(" ", found.group(2))):
                if said := declarations(body):
                    for selector in selectors.split(","):
                        self._add(selector.strip(), said)

    def _add(self, selector: str, said: list[tuple[str, str, int]]) -> None:
        found = _COMPOUND.fullmatch(selector)
        if not found:
            return
        tag, marks = (found.group(1) or "").lower(), re.findall(r"[.#][\w-]+", found.group(2) or "")
        key = next((m for m in marks if m[0] == "#"), marks[0] if marks else tag or "*")
        weight = sum(1 << 20 if m[0] == "#" else 1 << 10 for m in marks) + bool(tag)
        self.by.setdefault(key, []).append((weight, len(self.by), tag, frozenset(marks), said))

    def of(self, name: str, values: dict[str, str]) -> dict[str, str]:
        """Display and visibility of an element where rules or its own style say them."""
        own = values.get("style", "")
        if not self.by and not own:
            return {}
        marks = {f".{c}" for c in values.get("class", "").split()} | ({f"#{values['id']}"} if values.get("id") else set())
        best: dict[str, tuple[int, str]] = {}
        for key in (*marks, name, "*"):
            for weight, _, tag, wanted, said in self.by.get(key, ()):
                if (not tag or tag == name) and wanted <= marks:
                    for p, value, loud in said:
                        if (weight + loud) >= best.get(p, (-1, ""))[0]:
                            best[p] = (weight + loud, value)
        for p, value, loud in declarations(own):
            if INLINE + loud >= best.get(p, (-1, ""))[0]:
                best[p] = (INLINE + loud, value)
        return {p: value for p, (_, value) in best.items()}
