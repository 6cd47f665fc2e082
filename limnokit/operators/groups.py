"""Grouped statistics. All are partial aggregates, so a hot group shrinks
on the map side before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit.operators.joins import attach_group_values


def group_mean_sd(df: DataFrame, keys: list[str], value: str, mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Mean and sample SD of the values present."""
    return df.groupBy(*keys).agg(F.avg(value).alias(mean), F.stddev_samp(value).alias(sd))


def attach_mean_sd(df: DataFrame, keys: list[str], value: str, mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Every row with the mean and SD of its group.

    A window over the group would send a hot group to one task; this
    aggregates first and joins the small result back.
    """
    return attach_group_values(df, group_mean_sd(df, keys, value, mean, sd), keys, "mean-sd")


def filtered_mean(df: DataFrame, where: Column, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean per group over the rows that satisfy ``where``."""
    return df.filter(where).groupBy(*keys).agg(F.avg(value).alias(name))


def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_true(condition: Column) -> Column:
    """Number of rows where the condition is true; missing counts as no."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def global_mean(df: DataFrame, value: str, name: str = "mean") -> DataFrame:
    return df.agg(F.avg(value).alias(name))


def value_range(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Smallest and largest value present, overall or per group."""
    bounds = [F.min(value).alias("min_value"), F.max(value).alias("max_value")]
    return df.groupBy(*keys).agg(*bounds) if keys else df.agg(*bounds)


def level_set(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct combinations of the columns."""
    return df.select(*columns).distinct()


def conditional_shares(
    df: DataFrame, keys: list[str], conditions: dict[str, Column], share_of: str, share_name: str, total: str = "total"
) -> DataFrame:
    """Row count, one conditional count per entry, and one count as a share."""
    counts = [count_true(cond).alias(name) for name, cond in conditions.items()]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), *counts)
    return out.withColumn(share_name, F.try_divide(F.col(share_of), F.col(total)))


def roll_up_share(
    counts: DataFrame, keys: list[str], part: str, total: str, part_name: str, total_name: str, share_name: str
) -> DataFrame:
    """Coarser groups: sums of the counts, then the ratio of the sums."""
    out = counts.groupBy(*keys).agg(F.sum(total).alias(total_name), F.sum(part).alias(part_name))
    return out.withColumn(share_name, F.try_divide(F.col(part_name), F.col(total_name)))
