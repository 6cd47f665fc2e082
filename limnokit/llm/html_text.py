"""Visible text of HTML pages, laid out in lines.

A page is cut into tags and text, and a tree builder turns them into well
nested open and close events: it supplies implied end tags (``p``, ``li``, ``dt``,
``td``, ``tr``, ``option`` and others), ignores stray ones and closes what the
end leaves open. A renderer walks the events: what is not displayed (``head``,
scripts, ``hidden``, ``display:none`` of the element or of the page's style sheets,
``aria-hidden``, closed ``details``) gives no text, nor do titles, descriptions and
definitions of ``svg`` and annotations of ``math``, which else are inline (parts of
a formula run together); ``visibility`` is inherited and may be taken back inside;
white space collapses except in ``pre``; blocks start new lines, and paragraphs,
headings, lists and tables are set off by an empty line; list items carry a bullet
or their number; cells of a table are aligned in columns, over rows and columns
that they span. No step recurses or walks the open elements (their places are
kept by name), so time grows with the length of a page and not with its depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.llm.batches import text_pieces
from limnokit.llm.css_rules import Rules

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_BLANKS = re.compile(r"[ \t\r\n\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist audio video canvas object rp title".split())
#: Roots of foreign content: inline, but for what describes or defines. There ``/>`` ends any element.
FOREIGN = frozenset({"svg", "math"})
FOREIGN_UNSEEN = frozenset("desc defs metadata annotation annotation-xml".split())
#: Elements of foreign content set apart by a space.
_SPACED = frozenset({"text", "mtd"})
#: HTML again inside foreign content, and the start tags that end it elsewhere.
_HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SET_OFF = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
BLOCKS = SET_OFF | frozenset(
    "html body address article aside dd details dialog div dt fieldset figcaption footer form header hgroup hr legend li main nav option optgroup search section select summary caption thead tbody tfoot tr center dir menu".split()
)
#: An open element -> start tags before which it ends.
ENDS_BEFORE = {
    "p": SET_OFF | frozenset("address article aside details div fieldset figcaption footer form header hgroup hr main menu nav search section center dir li dd dt td th tr".split()),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "optgroup": frozenset({"optgroup"}),
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "thead": frozenset("tbody tfoot thead".split()),
    "tbody": frozenset("tbody tfoot thead".split()),
    "tfoot": frozenset("tbody tfoot thead".split()),
    "caption": frozenset("tr tbody thead tfoot td th".split()),
    "colgroup": frozenset("tr tbody thead tfoot colgroup".split()),
    "head": frozenset({"body"}) | (BLOCKS - {"html"}),
}
#: An implied end does not reach beyond these.
FENCES = {"li": frozenset("ul ol menu dir table".split()), "dt": frozenset({"dl", "table"}), "dd": frozenset({"dl", "table"})}
_TABLE_PARTS = frozenset("td th tr thead tbody tfoot caption colgroup".split())
#: Elements that do not keep a start tag from ending a ``p`` or the like around them.
_THIN = frozenset("p b i em strong span a font u small".split())
#: Start tag -> open elements that it ends.
_ENDED_BY = {tag: tuple(name for name, tags in ENDS_BEFORE.items() if tag in tags) for tag in frozenset().union(*ENDS_BEFORE.values())}


class _Open:
    """The open elements, and the places of those of each name."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.thick: list[int] = []  # places of all but the thin elements

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in _THIN:
            self.thick.append(len(self.stack))
        self.stack.append(name)

    def pop(self) -> str:
        name = self.stack.pop()
        self.places[name].pop()
        if name not in _THIN:
            self.thick.pop()
        return name

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((at[-1] for name in names if (at := self.places.get(name))), default=-1)


def tree_events(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, attributes)``, kind ``<``, ``>`` or ``t``; every open element is closed."""
    open_ = _Open()
    stack = open_.stack
    roots: list[int] = []  # places of svg and math in the stack
    at, n = 0, len(html)

    def foreign() -> bool:
        while roots and (roots[-1] >= len(stack) or stack[roots[-1]] not in FOREIGN):
            roots.pop()
        return bool(roots) and open_.last(_HTML_INSIDE) < roots[-1]

    def implied(tag: str) -> Iterator[tuple[str, str, str]]:
        enders = _ENDED_BY.get(tag, ())
        while (end := open_.last(enders)) >= 0:
            if tag in FENCES or tag in _TABLE_PARTS:
                fence = open_.last({"table"} | FENCES.get(tag, frozenset()))
            else:
                fence = open_.thick[-1] if open_.thick else -1
            if end < fence:
                return
            while len(stack) > end:
                yield ">", open_.pop(), ""

    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            yield "t", html[at:], ""
            break
        if found.start() > at:
            yield "t", html[at : found.start()], ""
        at = found.end()
        if found.group(1):
            name = found.group(1).lower()
            if name in ("body", "html"):
                continue
            place = open_.last((name,))
            if name == "p" and place < 0 or name == "br":
                yield "<", name, ""
                yield ">", name, ""
            elif place >= 0 and (name in _TABLE_PARTS or open_.last(("table",)) <= place):
                while len(stack) > place:
                    yield ">", open_.pop(), ""
        elif found.group(2):
            name, rest = found.group(2).lower(), found.group(3)
            inside = bool(roots) and foreign()
            while inside and name in _ENDS_FOREIGN:
                while len(stack) > roots[-1]:
                    yield ">", open_.pop(), ""
                inside = foreign()
            yield from implied(name)
            yield "<", name, rest
            if name in VOID or (rest.endswith("/>") and (inside or name in FOREIGN)):
                yield ">", name, ""
            elif name in RAW and not (inside and name == "title"):
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(html, at)
                stop = end.start() if end else n
                if name in ("textarea", "xmp", "title") and stop > at:
                    yield "t", html[at:stop], ""
                yield ">", name, ""
                at = html.find(">", stop) + 1 if end else n
                if at == 0:
                    at = n
            else:
                if name in FOREIGN:
                    roots.append(len(stack))
                open_.push(name)
    while stack:
        yield ">", open_.pop(), ""


def attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    return out


def _unseen(name: str, values: dict[str, str], display: str | None) -> bool:
    return (
        "hidden" in values
        or display == "none"
        or values.get("aria-hidden", "").lower() == "true"
        or (name == "dialog" and "open" not in values)
    )


class _Lines:
    """Lines of a block context: the page, or one table cell."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.indent, self.lead = 0, ""

    def text(self, value: str) -> None:
        if not self.now or self.now[-1].endswith(" "):
            value = value.lstrip(" ")
        if value:
            self.now.append(value)

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line or forced:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append(((" " * max(0, self.indent - len(self.lead)) + self.lead + line) if line else "").rstrip(" "))
            if line:
                self.lead = ""

    def put_lines(self, lines: list[str]) -> None:
        self.end_line()
        for i, line in enumerate(lines):
            if i == 0 and self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append((" " * self.indent + line).rstrip(" "))


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """Rows of ``(first column, lines, columns)``: a cell leaves out the columns that cells of rows above reach into."""
    taken: dict[int, int] = {}  # column -> the row up to which it is taken
    out = []
    for nr, row in enumerate(rows):
        at, cells = 0, []
        for lines, columns, down in row:
            while taken.get(at, -1) >= nr:
                at += 1
            cells.append((at, lines, columns))
            if down > 1:
                taken.update(dict.fromkeys(range(at, at + columns), nr + down - 1))
            at += columns
        out.append(cells)
    return out


def _table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of ``(lines of a cell, columns, rows it spans)`` with the columns aligned."""
    placed = _placed(rows)
    widths: list[int] = []
    for row in placed:
        for at, lines, columns in row:
            widths += [0] * (at + columns - len(widths))
            if columns == 1:
                widths[at] = max(widths[at], *map(len, lines), 0)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2)
    out = []
    for row in placed:
        for parts in zip_longest(*(lines for _, lines, _ in row), fillvalue=""):
            line = ""
            for (at, _, _), part in zip(row, parts, strict=True):
                if part:
                    line = (line + "  " if line and len(line) + 2 > starts[at] else line.ljust(starts[at])) + part
            out.append(line.rstrip(" "))
    first = next((i for i, x in enumerate(out) if x), len(out))
    return out[first:]


def visible_text(html: str | None) -> str:
    """All visible text of a page; a null or empty page gives the empty text."""
    if not html:
        return ""
    lines, rules = _Lines(), Rules(html)
    unseen, pre, opened, foreign, veiled = 0, 0, False, 0, False
    open_: list[tuple] = []  # name, whether it is gone or closed, whether what is around it is veiled
    lists: list[int | None] = []
    tables: list[dict] = []
    for kind, value, rest in tree_events(html):
        if kind == "t":
            if unseen or veiled or (open_ and open_[-1][:2] == ("details", "closed")):
                continue
            text = unescape(value) if "&" in value else value
            if pre:
                text = text.replace("\r\n", "\n")
                first, *others = (text[1:] if opened and text[:1] == "\n" else text).split("\n")
                opened = False
                if first:
                    lines.now.append(first)
                for part in others:
                    lines.end_line(forced=bool(lines.done or lines.now))
                    lines.now = [part] if part else []
            else:
                lines.text(_BLANKS.sub(" ", text))
        elif kind == "<":
            values = attributes(rest) if len(rest) > 1 else {}
            foreign += value in FOREIGN
            style = rules.of(value, values)
            gone = value in UNSEEN or (foreign > 0 and value in FOREIGN_UNSEEN) or _unseen(value, values, style.get("display"))
            inside_closed = bool(open_) and open_[-1][:2] == ("details", "closed") and value != "summary"
            gone = gone or inside_closed
            open_.append((value, "closed" if value == "details" and "open" not in values and not gone else gone, veiled))
            if "visibility" in style:
                veiled = veiled if style["visibility"] == "inherit" else style["visibility"] in ("hidden", "collapse")
            if gone:
                unseen += 1
                continue
            if unseen:
                continue
            if value == "br":
                lines.end_line(forced=bool(lines.now) or bool(lines.done))
            elif value in BLOCKS or value in ("td", "th"):
                if value not in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                    lines.end_line()
                    if value in SET_OFF and not (value in ("ul", "ol") and lists):
                        lines.gap = True
                if value in ("ul", "ol", "menu", "dir"):
                    lists.append(_number(values.get("start"), 1) if value == "ol" else None)
                    lines.indent += 2 if value != "ol" else 3
                elif value == "li":
                    if lists and lists[-1] is not None:
                        number = _number(values.get("value"), lists[-1])
                        lines.lead, lists[-1] = f"{number}. ", number + 1
                    else:
                        lines.lead = "- "
                elif value in ("blockquote", "dd"):
                    lines.indent += 2
                elif value == "pre":
                    pre += 1
                    opened = True  # a line feed right behind the tag is no text
                elif value == "table":
                    tables.append({"rows": [], "outer": lines, "lists": lists})
                    lines, lists = _Lines(), []
                elif value == "tr" and tables:
                    tables[-1]["rows"].append([])
                elif value in ("td", "th") and tables:
                    if not tables[-1]["rows"]:
                        tables[-1]["rows"].append([])
                    spans = max(1, min(_number(values.get("colspan"), 1), 1000)), _number(values.get("rowspan"), 1)
                    tables[-1]["span"] = (spans[0], min(spans[1], 65534) if spans[1] > 0 else 65534 if spans[1] == 0 else 1)
                    lines.end_line()
                    tables[-1].setdefault("before", []).append(lines)
                    lines = _Lines()
        else:
            name, state, veiled = open_.pop()
            foreign -= name in FOREIGN
            if state is True:
                unseen -= 1
                continue
            if unseen:
                continue
            if foreign and name in _SPACED:
                lines.text(" ")
            if name in ("td", "th") and tables and tables[-1].get("before"):
                lines.end_line()
                tables[-1]["rows"][-1].append((lines.done or [""], *tables[-1].pop("span", (1, 1))))
                lines = tables[-1]["before"].pop()
            elif name == "table" and tables:
                lines.end_line()
                table = tables.pop()
                inside = lines.done
                lines, lists = table["outer"], table["lists"]
                lines.put_lines(inside + _table_lines([r for r in table["rows"] if r]))
                lines.gap = True
            elif name in BLOCKS and name not in ("tr", "thead", "tbody", "tfoot"):
                lines.end_line()
                if name in ("ul", "ol", "menu", "dir"):
                    if lists:
                        lists.pop()
                    lines.indent -= 2 if name != "ol" else 3
                elif name == "li":
                    lines.lead = ""
                elif name in ("blockquote", "dd"):
                    lines.indent -= 2
                elif name == "pre":
                    pre -= 1
                if name in SET_OFF and not (name in ("ul", "ol") and lists):
                    lines.gap = True
    lines.end_line()
    return "\n".join(lines.done).strip("\n")


def _number(text: str | None, default: int) -> int:
    try:
        return int(text) if text else default
    except ValueError:
        return default


def extract_text(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key, text, n_lines, n_chars`` of every row of ``pages``.

    Null and empty pages give the empty text (0 lines). Broken markup never
    fails: what cannot be a tag is text. Repeated rows and null keys give a row
    each; other columns are ignored.
    """
    kind = pages.schema[key].dataType.simpleString()

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in text_pieces(batches, column):
            texts = [visible_text(x) for x in found.to_pylist()]
            n_lines = [x.count("\n") + 1 if x else 0 for x in texts]
            yield pa.record_batch(
                [rows.column(key), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(map(len, texts), pa.int64())],
                [key, "text", "n_lines", "n_chars"],
            )

    return pages.select(F.col(key), F.col(column)).mapInArrow(extract, f"{key} {kind}, text string, n_lines bigint, n_chars bigint")
