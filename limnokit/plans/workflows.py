"""The four workflows end to end."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.operators.doses import settled_doses
from limnokit.operators.linear_fit import linear_fit_of_doses
from limnokit.operators.loess import loess_curve
from limnokit.operators.saturation_fit import saturation_fit_of_doses
from limnokit.plans.background import chemistry_long, discharge_series, snow_series, temperature_profile
from limnokit.plans.catalogue import (
    fit_catalogue,
    incubation_counts,
    model_name,
    significance_roll_up,
    significance_shares,
)
from limnokit.plans.rates import uptake_rates
from limnokit.plans.screening import kept_rows, screen_outliers, with_normalised_rate
from limnokit.plans.speciation import convert_ammonium
from limnokit.sources.tables import union_tables

MODEL_KEYS = ["site", "inc_month", "type", "analyte"]
DOSE, RATE = "mean_spike_conc", "net_rate_om"


def readings_to_rates(months: Iterable[DataFrame], lake: DataFrame, strict: bool = False) -> DataFrame:
    """Monthly raw readings and lake conditions to the uptake-rate table."""
    return uptake_rates(convert_ammonium(union_tables(months), lake), strict)


@dataclass
class Fits:
    """Saturation and straight-line fits with the columns of the published tables."""

    saturation: DataFrame
    linear: DataFrame


def _with_model_name(fits: DataFrame) -> DataFrame:
    return fits.withColumn("model_name", model_name(*MODEL_KEYS))


def rates_to_fits(rates: DataFrame, rules: Iterable[dict] = tuple(fixed.OUTLIER_RULES)) -> Fits:
    """Normalise, screen, and fit both curves to every incubation.

    ``rates`` is read once: both fits start from its compact table of doses.
    """
    kept = kept_rows(screen_outliers(with_normalised_rate(rates), rules))
    doses = settled_doses(kept, MODEL_KEYS, DOSE, RATE)
    curves = _with_model_name(saturation_fit_of_doses(doses, MODEL_KEYS))
    lines = _with_model_name(linear_fit_of_doses(doses, MODEL_KEYS))
    saturation = curves.select(
        "model_name", "vmax", "km",
        F.col("se_km").alias("std_error_km"), F.col("p_km").alias("p_value_km"),
        F.col("se_vmax").alias("std_error_vmax"), F.col("p_vmax").alias("p_value_vmax"),
        "ci_low_km", "ci_high_km", "ci_low_vmax", "ci_high_vmax", "status",
    )
    linear = lines.select(
        "model_name", "intercept", "slope",
        F.col("se_slope").alias("std_error_slope"), F.col("p_slope").alias("p_value_slope"),
        F.col("se_intercept").alias("std_error_intercept"), F.col("p_intercept").alias("p_value_intercept"),
    )
    return Fits(saturation, linear)


@dataclass
class Summary:
    """Fit catalogue, incubation counts, shares and their roll-up."""

    catalogue: DataFrame
    counts: DataFrame
    shares: DataFrame
    roll_up: DataFrame


def fits_to_summary(
    saturation: DataFrame, linear: DataFrame, excluded: list[str] | DataFrame = tuple(fixed.EXCLUDED_MODELS)
) -> Summary:
    """Fit tables to the share of incubations with a significant saturation curve."""
    catalogue = fit_catalogue(saturation, linear, excluded)
    shares = significance_shares(catalogue)
    return Summary(catalogue, incubation_counts(catalogue), shares, significance_roll_up(shares))


@dataclass
class Context:
    """Discharge, snow, chemistry and temperature beside the incubations."""

    discharge: DataFrame
    snow: DataFrame
    chemistry: DataFrame
    temperature: DataFrame
    temperature_curve: DataFrame


def smooth_temperature(profile: DataFrame) -> DataFrame:
    """Local regression of temperature on the month, by colour group."""
    return loess_curve(profile, ["color_group"], "month_rank", "temp_c")


def context_series(discharge: DataFrame, snow: DataFrame, chemistry: DataFrame, water_year: int = fixed.WATER_YEAR) -> Context:
    """The daily and sampled tables to the context series and their smooth."""
    profile = temperature_profile(chemistry, water_year)
    return Context(
        discharge_series(discharge), snow_series(snow), chemistry_long(chemistry, water_year), profile, smooth_temperature(profile)
    )
