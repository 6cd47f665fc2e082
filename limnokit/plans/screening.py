"""Normalisation, outlier rules and site labels of the rate table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.numeric import all_of, any_of, label_rank, positive_ratio, ratio, recode
from limnokit.functions.text import leading_letters, paste, without_text
from limnokit.operators.groups import group_count
from limnokit.operators.joins import attach_group_values
from limnokit.operators.order_stats import box_stats
from limnokit.operators.reshape import to_long

RULE_KEYS = ["site", "inc_month", "type", "analyte"]
BOUNDS = ["rate_lt", "rate_gt", "spike_eq", "spike_ne"]


def with_normalised_rate(df: DataFrame) -> DataFrame:
    """Uptake per gram of organic matter, positive for uptake."""
    uptake = -F.col("net_delta_conc_hr") * F.col("volume_lake_water_l")
    return df.withColumn("net_rate_om", ratio(uptake, "afdm_g"))


def uptake_metrics(df: DataFrame) -> DataFrame:
    """Raw, per-gram and per-organic-matter uptake, one row each."""
    wide = df.withColumns(
        {
            "raw_uptake": -F.col("net_delta_conc_hr"),
            "weight_corrected": -ratio("net_delta_conc_hr", "weight_g"),
            "afdm_corrected": F.col("net_rate_om"),
        }
    )
    return to_long(wide, df.columns, fixed.UPTAKE_METRICS, "metric", "uptake")


def _crossed(rule: dict, rate: Column, spike: Column) -> list[Column]:
    tests = {
        "rate_lt": lambda bound: rate < F.lit(bound),
        "rate_gt": lambda bound: rate > F.lit(bound),
        "spike_eq": lambda bound: spike == F.lit(bound),
        "spike_ne": lambda bound: spike != F.lit(bound),
    }
    return [test(rule[name]) for name, test in tests.items() if rule.get(name) is not None]


def rule_flag(
    rules: Iterable[dict], keys: list[str] = RULE_KEYS, rate: str = "net_rate_om", spike: str = "spike_ug_l"
) -> Column:
    """Three-valued flag: true where some rule applies, NULL where that is unknown.

    One expression over the row, so overlapping rules and missing keys follow
    SQL logic and no join is needed. For rule sets of many hundreds use
    :func:`flag_by_rule_table`.
    """
    # Rules with the same bounds share one test of the rate and dose
    by_bounds: dict[tuple, list[Column]] = {}
    for rule in rules:
        bounds = tuple(rule.get(name) for name in BOUNDS)
        same_key = all_of([F.col(k) == F.lit(rule[k]) for k in keys])
        by_bounds.setdefault(bounds, []).append(same_key)
    clauses = [
        all_of([any_of(matches), *_crossed(dict(zip(BOUNDS, bounds)), F.col(rate), F.col(spike))])
        for bounds, matches in by_bounds.items()
    ]
    return any_of(clauses)


def flag_by_rule_table(
    df: DataFrame,
    rules: DataFrame,
    keys: list[str] = RULE_KEYS,
    rate: str = "net_rate_om",
    spike: str = "spike_ug_l",
    name: str = "flag",
) -> DataFrame:
    """The same flag from a table of rules; several rules for one key hold side by side.

    Rows without a rule are false; rows with a missing key are unknown.
    """
    listed = rules.groupBy(*keys).agg(F.collect_set(F.struct(*BOUNDS)).alias("__rules"))
    joined = attach_group_values(df, listed, keys, "rules")

    def crossed(rule: Column) -> Column:
        return all_of(
            [
                rule["rate_lt"].isNull() | (F.col(rate) < rule["rate_lt"]),
                rule["rate_gt"].isNull() | (F.col(rate) > rule["rate_gt"]),
                rule["spike_eq"].isNull() | (F.col(spike) == rule["spike_eq"]),
                rule["spike_ne"].isNull() | (F.col(spike) != rule["spike_ne"]),
            ]
        )

    unknown = any_of([F.col(k).isNull() for k in keys])
    some = F.when(F.col("__rules").isNotNull(), F.exists("__rules", crossed))
    flag = some.when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.withColumn(name, flag).drop("__rules")


def screen_outliers(df: DataFrame, rules: Iterable[dict] = tuple(fixed.OUTLIER_RULES)) -> DataFrame:
    """The rate table with its nullable ``flag``; rules see the site name as delivered."""
    return df.withColumn("flag", rule_flag(rules))


def flagged_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("flag"))


def kept_rows(df: DataFrame) -> DataFrame:
    """Rows known not to be outliers, with underscores taken out of the site name."""
    # One test of the flag as a whole: a negation is taken apart, and its parts are computed again at the scan
    return df.filter(F.col("flag").eqNullSafe(False)).withColumn("site", without_text("site", "_"))


def flag_report(df: DataFrame) -> DataFrame:
    """Number of flagged rows per site, month, analyte and type."""
    return group_count(flagged_rows(df), ["site", "inc_month", "analyte", "type"], "filtered_count")


def flag_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("flag").alias("n_flagged"))


def zone_of(depth: Column | str, zones: dict[float, str] = fixed.DEPTH_ZONES) -> Column:
    """Zone of a depth, NULL for a depth not listed."""
    return recode(depth, zones, keep_unmatched=False)


def with_site_label(df: DataFrame) -> DataFrame:
    """Zone, letters of the site name, and both pasted together."""
    return (
        df.withColumn("location", zone_of("depth"))
        .withColumn("site_prefix", leading_letters("site"))
        .withColumn("new_site", paste("site_prefix", "location"))
    )


def with_standardised_uptake(df: DataFrame, rate: str = "net_rate_om", dose: str = "mean_spike_conc") -> DataFrame:
    """Control label and uptake per unit of dose (spiked rows only)."""
    label = F.when(F.col(dose) == 0, "control").when(F.col(dose).isNotNull(), "spiked")
    return df.withColumn("is_control", label).withColumn("standardized_uptake", positive_ratio(rate, dose))


def with_report_ranks(df: DataFrame, site: str = "new_site", month: str = "inc_month", metric: str = "metric") -> DataFrame:
    """Places of sites, months and metrics in report order, for those of the columns that there are."""
    orders = {"site_rank": (site, fixed.SITE_ORDER), "month_rank": (month, fixed.INCUBATION_MONTHS), "metric_rank": (metric, fixed.UPTAKE_METRICS)}
    return df.withColumns({rank: label_rank(column, labels) for rank, (column, labels) in orders.items() if column in df.columns})


def rate_figures(rates: DataFrame, value: str = "net_rate_om", dose: str = "mean_spike_conc") -> DataFrame:
    """Box statistics of the spiked rows by zone label, month and analyte, with their ranks in reports."""
    spiked = with_site_label(rates).filter(F.col(dose) > 0)
    return with_report_ranks(box_stats(spiked, ["new_site", "inc_month", "analyte"], value))
