"""Readings collapsed to one row per group and dose, the table that both fits start from.

Equal doses of a group become (count, mean, spread) without loss, so a line
and a curve through any number of readings need nothing else, and the readings
are read once for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.operators.joins import null_safe_join
from limnokit.session import compiled_steps, settle


def compact_doses(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One row per group and dose ``x``: readings used (``n``), their mean and squared spread.

    Readings without a rate are only counted (in ``rows``). Missing doses are
    a row of their own, and so is each negative dose: a line takes it, a curve
    does not.
    """
    dose = F.col(x).cast("double")
    usable = F.when(dose.isNotNull(), F.col(y).cast("double"))
    return (
        df.select(*keys, dose.alias("x"), usable.alias("y"))
        .groupBy(*keys, "x")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("y").alias("n"),
            F.avg("y").alias("y_mean"),
            (F.var_pop("y") * F.count("y")).alias("spread"),
        )
    )


def settled_doses(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """:func:`compact_doses`, computed once for every step and fit that reads it."""
    with compiled_steps(df.sparkSession):
        return settle(compact_doses(df, keys, x, y), "doses")


def line_moments(doses: DataFrame, keys: list[str]) -> DataFrame:
    """Centred sums per group of a compact table, as ``linear_fit.linear_moments`` has them of readings.

    The means come first; deviations from them are summed in a second pass, so
    nothing cancels. Groups without a complete pair have ``n`` 0.
    """
    n, x, y = F.col("n"), F.col("x"), F.col("y_mean")
    used = F.when((n > 0) & x.isNotNull(), n)
    centres = doses.groupBy(*keys).agg(
        F.coalesce(F.sum(used), F.lit(0)).alias("n_all"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.try_divide(F.sum(used * x), F.sum(used)).alias("x_centre"),
        F.try_divide(F.sum(used * y), F.sum(used)).alias("y_centre"),
    )
    pairs = null_safe_join(doses, settle(centres, "dose-centres"), keys, "inner")
    dx, dy = x - F.col("x_centre"), y - F.col("y_centre")
    group = [*keys, "n_all", "x_min", "x_max", "x_centre", "y_centre"]
    sums = pairs.groupBy(*group).agg(
        F.sum(used * dx * dx).alias("sxx"),
        F.sum(F.when(used.isNotNull(), F.col("spread") + n * dy * dy)).alias("syy"),
        F.sum(used * dx * dy).alias("sxy"),
    )
    return sums.withColumnsRenamed({"n_all": "n", "x_centre": "x_mean", "y_centre": "y_mean"})
