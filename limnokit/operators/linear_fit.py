"""Straight-line regression for every group in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit.functions.tdist import two_sided_p
from limnokit.operators.doses import line_moments


def linear_moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Centred sums per group over complete pairs: a mergeable partial aggregate."""
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.regr_avgy(y, x).alias("y_mean"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )


def linear_fit(
    df: DataFrame, keys: list[str], x: str, y: str, p_values: bool = True, keep_failed: bool = False
) -> DataFrame:
    """Intercept and slope with SE, t and two-sided p on n - 2 df.

    ``status`` is ``ok``; ``exact`` where no residual df or no residual
    variance is left to give an SE; ``failed`` where no line is defined
    (fewer than two distinct x). Failed groups give no row unless kept.
    """
    return _fitted(linear_moments(df, keys, x, y), keys, p_values, keep_failed)


def linear_fit_of_doses(doses: DataFrame, keys: list[str], p_values: bool = True, keep_failed: bool = False) -> DataFrame:
    """:func:`linear_fit` from a settled table of :func:`limnokit.operators.doses.compact_doses`."""
    return _fitted(line_moments(doses, keys), keys, p_values, keep_failed)


def _fitted(moments: DataFrame, keys: list[str], p_values: bool, keep_failed: bool) -> DataFrame:
    sxx, sxy, n = F.col("sxx"), F.col("sxy"), F.col("n")
    fitted = (
        moments.withColumn("slope", F.when(sxx > 0, sxy / sxx))
        .withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
        .withColumn("df_resid", n - 2)
        .withColumn("rss", F.greatest(F.col("syy") - F.col("slope") * sxy, F.lit(0.0)))
        .withColumn("s2", F.when(F.col("df_resid") > 0, F.col("rss") / F.col("df_resid")))
        .withColumn("se_slope", F.sqrt(F.try_divide("s2", "sxx")))
        .withColumn(
            "se_intercept",
            F.when(F.col("se_slope").isNotNull(), F.sqrt(F.col("s2") * (1 / n + F.col("x_mean") ** 2 / sxx))),
        )
        .withColumn("t_slope", F.try_divide("slope", "se_slope"))
        .withColumn("t_intercept", F.try_divide("intercept", "se_intercept"))
        .withColumn(
            "status",
            F.when(F.col("slope").isNull(), "failed")
            .when(F.col("t_slope").isNull(), "exact")
            .otherwise("ok"),
        )
    )
    if not keep_failed:
        fitted = fitted.filter(F.col("status") != "failed")
    columns = [
        *keys, "n", "x_min", "x_max", "intercept", "slope", "se_intercept", "se_slope",
        "t_intercept", "t_slope", "df_resid", "status",
    ]
    out = fitted.select(*columns)
    return with_p_values(out, {"t_intercept": "p_intercept", "t_slope": "p_slope"}) if p_values else out


def with_p_values(fits: DataFrame, names: dict[str, str], df_resid: str = "df_resid") -> DataFrame:
    """Add the p-value of each t column."""
    return fits.withColumns({p: two_sided_p(t, df_resid) for t, p in names.items()})


def line_at(x: Column) -> Column:
    """The fitted line at ``x``."""
    return F.col("intercept") + F.col("slope") * x
