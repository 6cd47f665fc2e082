"""Equi-joins in which a missing key matches a missing key, semi and anti joins.

No join carries an unconditional broadcast hint. Lookups held in files, or
settled with :func:`limnokit.session.settle`, have a size Catalyst knows: it
broadcasts them below its threshold and otherwise shuffles, with adaptive
skew splitting for hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.functions.numeric import not_in
from limnokit.session import settle

Key = str | tuple[str, str]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[Key], how: str = "left") -> DataFrame:
    """Join on ``<=>``; the right side's key columns are dropped.

    A key is a shared name or a ``(left name, right name)`` pair.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    right_names = [r for _, r in pairs]
    payload = [c for c in right.columns if c not in right_names]
    clash = set(payload) & set(left.columns)
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    marks = [f"__key_{i}" for i in range(len(pairs))]
    side = right.select(*[F.col(r).alias(m) for (_, r), m in zip(pairs, marks)], *payload)
    on = reduce(lambda a, b: a & b, [F.col(f"l.{lk}").eqNullSafe(F.col(f"r.{m}")) for (lk, _), m in zip(pairs, marks)])
    joined = left.alias("l").join(side.alias("r"), on, how)
    return joined.drop(*marks)


def attach_group_values(df: DataFrame, groups: DataFrame, keys: list[Key], label: str = "groups") -> DataFrame:
    """Left-join a per-group aggregate back to rows.

    The aggregate is settled first: it is computed once, and its known size
    decides between a broadcast (rows are not moved at all) and a shuffle.
    """
    return null_safe_join(df, settle(groups, label), keys, "left")


def keep_listed(df: DataFrame, values: list | DataFrame, column: str) -> DataFrame:
    """Rows whose value is listed: a filter for a list, a semi join for a table.

    A frame made from Python rows has no size Catalyst knows; pass the list
    itself, or settle the frame first.
    """
    if isinstance(values, list):
        return df.filter(F.col(column).isin(values))
    return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")


def drop_listed(df: DataFrame, values: list | DataFrame, column: str) -> DataFrame:
    """Rows whose value is not listed; missing values stay.

    A list held by the caller becomes a filter, which reaches the scan; a
    table becomes an anti join.
    """
    if isinstance(values, list):
        return df.filter(not_in(column, values)) if values else df
    return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_anti")


def recode_from_table(
    df: DataFrame, column: str, table: DataFrame, target: str, keep_unmatched: bool = True
) -> DataFrame:
    """Replace values through a (value, label) table; of several labels of a value the least is used."""
    source, label = table.columns[:2]
    renamed = table.groupBy(source).agg(F.min(label).alias("__label"))
    joined = null_safe_join(df, renamed, [(column, source)])
    value = F.coalesce("__label", column) if keep_unmatched else F.col("__label")
    return joined.withColumn(target, value).drop("__label")
