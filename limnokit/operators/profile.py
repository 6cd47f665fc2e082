"""Column profiles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit.operators.joins import null_safe_join
from limnokit.operators.order_stats import quantiles_of_sketches, rank_sketch
from limnokit.session import settle


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def profile(df: DataFrame, columns: list[str], quartiles: bool = False) -> DataFrame:
    """Row, missing count, mean, SD, min and max of each numeric column.

    All columns come from a single aggregate over one scan; the one-row
    result is then turned on its side. With exact quartiles that aggregate
    also sketches every column, and a second scan counts for all of them.
    """
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        fields = [
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(v.isNull()).alias("n_missing"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ]
        if quartiles:
            fields += [F.count(v).alias("n"), rank_sketch(v, QUARTILES).alias("sketch")]
        aggs.append(F.struct(*fields))
    out = df.agg(F.array(*aggs).alias("stats")).select(F.explode("stats").alias("s")).select("s.*")
    if not quartiles:
        return out
    out = settle(out, "profile")
    points = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")).select("p.*").filter("v IS NOT NULL")
    found = quantiles_of_sketches(points, out.select("column", "n", "sketch"), ["column"], QUARTILES)
    return null_safe_join(out.drop("n", "sketch"), found.drop("n"), ["column"])


def head(df: DataFrame, n: int = 6) -> DataFrame:
    """A few rows, for looking at."""
    return df.limit(n)
