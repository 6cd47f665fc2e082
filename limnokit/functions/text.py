"""Text expressions; each states what a missing text gives."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def starts_with_any(c: Column | str, prefixes: list[str]) -> Column:
    """Whether the text starts with one of the prefixes (any text, if none is given); a missing text does not."""
    starts = [_col(c).startswith(p) for p in prefixes or [""]]
    return F.coalesce(reduce(lambda a, b: a | b, starts), F.lit(False))


def contains_text(c: Column | str, text: str) -> Column:
    """Substring test; a missing text does not match."""
    return F.coalesce(_col(c).contains(text), F.lit(False))


def without_text(c: Column | str, text: str) -> Column:
    """``c`` with every occurrence of ``text`` removed."""
    return F.replace(_col(c), F.lit(text), F.lit(""))


def leading_letters(c: Column | str) -> Column:
    """Letters at the start of the text, NULL where there are none."""
    return F.nullif(F.regexp_extract(_col(c), "^[A-Za-z]+", 0), F.lit(""))


def paste(*cols: Column | str, sep: str = "") -> Column:
    """Concatenation in which a missing part becomes the text ``NA``."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def key_part(c: Column | str, index: int, sep: str = "_") -> Column:
    """The ``index``-th part of a separated key, NULL when it is too short."""
    return F.get(F.split(_col(c), re.escape(sep)), F.lit(index))
