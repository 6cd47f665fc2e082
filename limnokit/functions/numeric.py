"""Numeric expressions; a division by zero is NULL, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.text import _col


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, NULL where the denominator is zero or missing."""
    return F.try_divide(_col(numerator), _col(denominator))


def row_min(*cols: Column | str) -> Column:
    """Smallest of the values present in the row."""
    return F.least(*[_col(c) for c in cols])


def mg_to_ug(c: Column | str) -> Column:
    return F.lit(fixed.UG_PER_MG) * _col(c)


def ug_to_mg(c: Column | str) -> Column:
    return _col(c) / F.lit(fixed.UG_PER_MG)


def cfs_to_cms(c: Column | str) -> Column:
    return _col(c) * F.lit(fixed.CMS_PER_CFS)


def positive_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient where the denominator is positive, NULL elsewhere."""
    return F.when(_col(denominator) > 0, _col(numerator) / _col(denominator))


def not_in(c: Column | str, values: list) -> Column:
    """Negated membership that keeps missing values."""
    return ~F.coalesce(_col(c).isin(values), F.lit(False))


def is_in(c: Column | str, values: list) -> Column:
    """Membership; a missing value is not a member."""
    return F.coalesce(_col(c).isin(values), F.lit(False))


def recode(c: Column | str, mapping: dict, keep_unmatched: bool = True) -> Column:
    """Replace listed values; others are kept, or NULL if ``keep_unmatched`` is off."""
    source = _col(c)
    branches = list(mapping.items())
    expr = F.when(source == F.lit(branches[0][0]), F.lit(branches[0][1]))
    for key, label in branches[1:]:
        expr = expr.when(source == F.lit(key), F.lit(label))
    return expr.otherwise(source) if keep_unmatched else expr


def label_rank(c: Column | str, labels: list[str]) -> Column:
    """1-based place of a label in a fixed order; unlisted labels give NULL."""
    return recode(c, {label: i + 1 for i, label in enumerate(labels)}, keep_unmatched=False)


def any_of(conditions: list[Column]) -> Column:
    """Three-valued OR of the conditions; false without any."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    """Three-valued AND of the conditions."""
    return reduce(lambda a, b: a & b, conditions)
