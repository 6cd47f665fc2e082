"""Response curves on an even grid of x."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.operators.linear_fit import line_at, linear_fit


def saturation_at(x: Column) -> Column:
    """The fitted saturation curve at ``x``."""
    return F.try_divide(F.col("vmax") * x, F.col("km") + x)


def predict_grid(
    fits: DataFrame,
    keys: list[str],
    curve: Callable[[Column], Column],
    x_max: str = "x_max",
    points: int = fixed.CURVE_POINTS,
) -> DataFrame:
    """``points`` equally spaced x from 0 to each group's largest x, with the curve's y.

    Works on one row per group and never touches the readings again.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    grid = fits.select("*", steps).withColumn("x", F.col("point") * F.col(x_max) / F.lit(points - 1))
    return grid.select(*keys, "point", "x", curve(F.col("x")).alias("y"))


def trend_line(df: DataFrame, keys: list[str], x: str, y: str, points: int = fixed.TREND_POINTS) -> DataFrame:
    """Least-squares line per group, drawn between its smallest and largest x."""
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fits = linear_fit(complete, keys, x, y, p_values=False)
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    span = (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    grid = fits.select("*", steps).withColumn("x", F.col("x_min") + F.col("point") * span)
    return grid.select(*keys, "point", "x", line_at(F.col("x")).alias("y"))
