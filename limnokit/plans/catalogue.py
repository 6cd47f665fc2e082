"""Fit catalogue and the share of experiments that saturate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.numeric import recode
from limnokit.functions.text import contains_text, key_part, paste
from limnokit.operators.groups import conditional_shares, group_count, roll_up_share
from limnokit.operators.joins import drop_listed, null_safe_join

MODEL_PARTS = ["site", "month", "substrate", "n_type"]
GROUP = ["stream", "depth_loc", "substrate", "n_type"]
COARSE_GROUP = ["stream", "substrate", "n_type"]


def model_name(site: str, month: str, substrate: str, analyte: str) -> Column:
    """``Site_Month_Substrate_NType``."""
    return paste(site, month, substrate, analyte, sep="_")


def split_model_name(df: DataFrame, name: str = "model_name") -> DataFrame:
    """The four parts of a model name as columns; absent parts are NULL."""
    return df.withColumns({part: key_part(name, i) for i, part in enumerate(MODEL_PARTS)})


def with_site_parts(df: DataFrame, labels: dict[str, str] = fixed.SITE_LABELS) -> DataFrame:
    """``site_id`` label of a site, and its stream and zone."""
    out = df.withColumn("site_id", recode("site", labels))
    return out.withColumns({"stream": key_part("site_id", 0), "depth_loc": key_part("site_id", 1)})


def fit_catalogue(
    mm_fits: DataFrame, linear_fits: DataFrame, excluded: list[str] | DataFrame = tuple(fixed.EXCLUDED_MODELS)
) -> DataFrame:
    """Saturation fits with their straight-line fits, exclusions dropped, names split."""
    listed = excluded if isinstance(excluded, DataFrame) else list(excluded)
    fits = drop_listed(null_safe_join(mm_fits, linear_fits, ["model_name"]), listed, "model_name")
    return with_site_parts(split_model_name(fits))


def incubation_counts(fits: DataFrame) -> DataFrame:
    """Fits per stream, zone, substrate and analyte."""
    return group_count(fits, GROUP)


def with_significance(fits: DataFrame, alpha: float = fixed.SIGNIFICANCE_LEVEL) -> DataFrame:
    """``yes`` / ``no`` / missing for Vmax, Km and both."""

    def label(condition: Column) -> Column:
        return F.when(condition, "yes").when(~condition, "no")

    return (
        fits.withColumn("vmax_sig", label(F.col("p_value_vmax") < F.lit(alpha)))
        .withColumn("km_sig", label(F.col("p_value_km") < F.lit(alpha)))
        .withColumn("vmax_km_sig", label((F.col("vmax_sig") == "yes") & (F.col("km_sig") == "yes")))
    )


def significance_shares(fits: DataFrame, keys: list[str] = GROUP, alpha: float = fixed.SIGNIFICANCE_LEVEL) -> DataFrame:
    """Fits, significant fits of each kind, and the share with both significant."""
    flagged = with_significance(fits, alpha)
    names = {"n_vmax_sig": "vmax_sig", "n_km_sig": "km_sig", "n_vmax_km_sig": "vmax_km_sig"}
    conditions = {name: contains_text(source, "yes") for name, source in names.items()}
    return conditional_shares(flagged, keys, conditions, "n_vmax_km_sig", "prop_mm_bothsig")


def significance_roll_up(shares: DataFrame, keys: list[str] = COARSE_GROUP) -> DataFrame:
    """The shares over coarser groups, as a ratio of summed counts."""
    return roll_up_share(
        shares, keys, "n_vmax_km_sig", "total", "sum_vmax_km_sig", "sum_total", "prop_sig"
    )
