"""Discharge, snow, chemistry and temperature series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.clock import month_label, short_date
from limnokit.functions.numeric import cfs_to_cms, is_in, label_rank, not_in, recode, ug_to_mg
from limnokit.functions.text import contains_text
from limnokit.operators.joins import keep_listed
from limnokit.operators.ordered import with_change_and_total
from limnokit.operators.reshape import to_long


def gauge_discharge(df: DataFrame, site: str, label: str, area_km2: float) -> DataFrame:
    """One gauge's discharge in m3/s, and per km2 of its catchment."""
    cms = cfs_to_cms("discharge_cfs")
    return df.select(
        "date",
        "discharge_cfs",
        F.lit(site).alias("site"),
        F.lit(label).alias("label"),
        cms.alias("discharge_cms"),
        (cms / F.lit(area_km2)).alias("scale_q"),
    )


def discharge_series(
    daily: DataFrame,
    gauges: dict[str, dict] = fixed.GAUGES,
    start: str = fixed.SERIES_START,
    end: str = fixed.SERIES_END,
) -> DataFrame:
    """All gauges' discharge, scaled gauge by gauge, in one table.

    Per-gauge constants are row expressions, so the gauges need one scan, not
    one scan each; rows of other gauges are dropped.
    """
    def per_gauge(field: str) -> Column:
        return recode("site_no", {no: g[field] for no, g in gauges.items()}, keep_unmatched=False)

    in_period = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    known = daily.filter(F.col("site_no").isin(list(gauges)) & in_period)
    return known.select(
        F.col("date").cast("date").alias("date"),
        "discharge_cfs",
        per_gauge("site").alias("site"),
        per_gauge("label").alias("label"),
        cfs_to_cms("discharge_cfs").alias("discharge_cms"),
        (cfs_to_cms("discharge_cfs") / per_gauge("area_km2")).alias("scale_q"),
    )


def change_series(
    df: DataFrame, keys: list[str], date: str, level: str, slice_by: Column | None = None, tie_break: list[str] | None = None
) -> DataFrame:
    """Day-on-day change, its running total, and its sign as labels.

    The first day changes from 0, so the running total is the level; a gap
    makes the total missing from there on.
    """
    sliced = df.withColumn("__month", F.trunc(date, "month") if slice_by is None else slice_by)
    order = [date, *(tie_break or [])]
    out = with_change_and_total(sliced, keys, order, level, "__month", "daily_delta", "cumulative").drop("__month")
    change = F.col("daily_delta")
    return out.withColumn("quality", F.when(change > 0, "Accumulate").when(change <= 0, "Melt")).withColumn(
        "rain", F.when(change < 0, 1).when(change >= 0, 0)
    )


def snow_series(
    daily: DataFrame, start: str = fixed.SERIES_START, end: str = fixed.SERIES_END
) -> DataFrame:
    """Snow-water equivalent per site with daily change, running total and class."""
    site = F.when(F.col("site_id").isNull(), F.lit(None))
    for station, label in fixed.SNOW_STATION_SITES.items():
        site = site.when(F.col("site_id") == F.lit(station), F.lit(label))
    in_period = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    labelled = daily.filter(in_period).withColumn("site", site.otherwise(F.lit(fixed.SNOW_DEFAULT_SITE)))
    return change_series(labelled, ["site"], "date", "snow_water_equivalent", tie_break=["site_id"])


def on_dates(df: DataFrame, date: str, dates: list[str] = fixed.HIGHLIGHT_DATES) -> DataFrame:
    """Rows on the listed days: a filter that reaches the scan."""
    return keep_listed(df, [F.lit(d).cast("date") for d in dates], date)


def position_of(site: Column | str) -> Column:
    """Position label of a chemistry site, NULL for other sites."""
    return recode(site, fixed.SITE_POSITIONS, keep_unmatched=False)


def chemistry_long(chemistry: DataFrame, water_year: int = fixed.WATER_YEAR) -> DataFrame:
    """One row per sample and solute present, in mg/L, with position and plot limit."""
    wide = (
        chemistry.filter(F.col("water_year") == water_year)
        .filter(not_in("site", fixed.EXCLUDED_CHEMISTRY_SITES))
        .withColumn("po4_mgl_dl", ug_to_mg("po4_ugl_dl"))
        .withColumn("position", position_of("site"))
        .withColumn("date", short_date("date"))
    )
    ids = [c for c in wide.columns if c not in fixed.SOLUTES]
    long = to_long(wide, ids, fixed.SOLUTES, "variable", "concentration")
    return (
        long.filter(F.col("concentration").isNotNull())
        .withColumn(
            "y_limit",
            F.coalesce(
                recode("variable", fixed.SOLUTE_LIMITS, keep_unmatched=False), F.lit(fixed.DEFAULT_SOLUTE_LIMIT)
            ),
        )
        .withColumn("position_rank", label_rank("position", fixed.CHEMISTRY_POSITION_ORDER))
    )


def temperature_profile(chemistry: DataFrame, water_year: int = fixed.WATER_YEAR) -> DataFrame:
    """Temperature by month and position, January to September."""
    out = (
        chemistry.filter(F.col("water_year") == water_year)
        .withColumn("position", position_of("site"))
        .withColumn("color_group", F.when(contains_text("position", "GB"), "GB").otherwise("BW"))
        .withColumn("month", month_label(short_date("date")))
        .withColumn("month_rank", label_rank("month", fixed.MONTH_LABELS))
        .withColumn("position_rank", label_rank("position", fixed.TEMPERATURE_POSITION_ORDER))
    )
    return out.filter(is_in("month", fixed.PROFILE_MONTHS) & F.col("position").isNotNull())
