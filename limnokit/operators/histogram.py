"""Histograms over round-numbered, right-closed cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def break_range(low: float, high: float, cells: int) -> tuple[int, float, int]:
    """About ``cells`` equal cells covering the range, with width 1, 2 or 5 times a power of ten.

    Gives the first and last break as multiples of the width, and the width.

    The width is the largest of 1, 2, 5 and 10 times the power of ten below
    the exact cell width that still leaves enough cells.
    """
    span = high - low
    if span <= 0:
        span = max(abs(low), abs(high), 1.0) * 1e-7 or 1.0
    exact = span / cells
    base = 10.0 ** math.floor(math.log10(exact))
    # Bias towards wider cells, for 1-2-10 and for 5
    bias, bias_five = 1.5, 2.75
    width = base
    for factor, weight in ((2, bias), (5, bias_five), (10, bias)):
        if factor * base - exact < weight * (exact - width):
            width = factor * base
        else:
            break
    first = math.floor(low / width + 1e-7)
    last = math.ceil(high / width - 1e-7)
    while first * width > low + 1e-7 * width:
        first -= 1
    while last * width < high - 1e-7 * width:
        last += 1
    if last == first:
        last += 1
    return first, width, last


def round_breaks(low: float, high: float, cells: int) -> list[float]:
    """The breaks of :func:`break_range` one by one."""
    first, width, last = break_range(low, high, cells)
    return [i * width for i in range(first, last + 1)]


def histogram(df: DataFrame, value: str, cells: int | None = None) -> DataFrame:
    """Counts per cell of the finite values; Sturges' number of cells unless given.

    Needs three numbers of the whole column (count, min, max), read first in
    one aggregate; the counting itself is one pass with partial counts.
    Empty cells are listed with 0; missing, infinite and NaN values are not
    counted.
    """
    v = F.col(value).cast("double")
    finite = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    n, low, high = finite.agg(F.count(value), F.min(v), F.max(v)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "cell int, lower double, upper double, n bigint")
    first, width, last = break_range(low, high, cells or math.ceil(math.log2(n) + 1))
    # A value within the fuzz above a break still belongs to the cell below it
    cell = F.ceil((v - F.lit(first * width + 1e-7 * width)) / F.lit(width)).cast("int")
    cell = F.least(F.greatest(cell, F.lit(1)), F.lit(last - first))
    counts = finite.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(1, last - first + 1).select(F.col("id").cast("int").alias("cell"))

    def edge(back: int) -> Column:
        return (F.lit(first) + F.col("cell") - F.lit(back)) * F.lit(width)

    return frame.join(counts, "cell", "left").select(
        "cell", edge(1).alias("lower"), edge(0).alias("upper"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )
