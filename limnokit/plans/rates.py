"""Concentrations to uptake rates net of baseline and water column.

Only per-group sums ever leave the rows: the two control tables are small
aggregates, settled and joined back, so the readings themselves are not
shuffled while those tables stay below the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.clock import with_incubation_hours
from limnokit.functions.numeric import mg_to_ug, ratio, recode, row_min
from limnokit.operators.groups import attach_mean_sd, filtered_mean
from limnokit.operators.joins import null_safe_join
from limnokit.session import compiled_steps, settle

REPLICATE_KEYS = ["site", "location", "inc_month", "type", "analyte", "spike_ug_l"]
BASELINE_KEYS = ["shore", "inc_month", "analyte", "spike_ug_l"]
RATE_COLUMNS = [
    "inc_month", "site", "location", "depth", "analyte", "spike_ug_l", "mean_spike_conc", "volume_lake_water_l",
    "type", "no2_no3_mgn_l", "nh4_mgn_l", "conc_ugn_l", "ph", "weight_g", "afdm_g", "real_icu_hrc", "delta_conc",
    "delta_conc_hr", "water_delta_conc_hr", "net_delta_conc_hr",
]


def limit_substituted(
    conc: Column,
    analyte: Column,
    nh3_limit: float = fixed.NH3_DETECTION_LIMIT,
    nh3_value: float = fixed.NH3_BELOW_LIMIT,
    no3_limit: float = fixed.NO3_DETECTION_LIMIT,
    no3_value: float = fixed.NO3_BELOW_LIMIT,
    strict: bool = False,
    nh3_label: str = "NH3",
    no3_label: str = "NO3",
) -> Column:
    """Concentrations below the detection limit, replaced.

    The limits are tried in order, so a nitrate value below the ammonia limit
    is left as it is; with ``strict`` each analyte is judged by its own limit
    alone. A value below the first limit of an unnamed analyte is missing.
    """
    if strict:
        own_nh3 = (analyte == nh3_label) & (conc < F.lit(nh3_limit))
        own_no3 = (analyte == no3_label) & (conc < F.lit(no3_limit))
        return F.when(own_nh3, F.lit(nh3_value)).when(own_no3, F.lit(no3_value)).otherwise(conc)
    below_first = F.when(analyte == nh3_label, F.lit(nh3_value)).when(analyte.isNotNull(), conc)
    return (
        F.when(conc < F.lit(nh3_limit), below_first)
        .when((conc < F.lit(no3_limit)) & (analyte == no3_label), F.lit(no3_value))
        .otherwise(conc)
    )


def clean_readings(df: DataFrame, strict: bool = False) -> DataFrame:
    """Detection limits applied, in micrograms, positive readings only; incubation hours."""
    smaller = df.withColumn("__conc", row_min("nh4_mgn_l", "no2_no3_mgn_l"))
    substituted = limit_substituted(F.col("__conc"), F.col("analyte"), strict=strict)
    positive = smaller.withColumn("conc_ugn_l", mg_to_ug(substituted)).drop("__conc").filter(F.col("conc_ugn_l") > 0)
    return with_incubation_hours(positive, "actual_incubation_hrs", "real_icu_hrc")


def with_replicate_stats(df: DataFrame) -> DataFrame:
    """Mean and SD of each set of replicates, on every row."""
    return attach_mean_sd(df, REPLICATE_KEYS, "conc_ugn_l", "mean_conc", "sd_conc")


def patched_baseline(spike: Column, baseline: Column) -> Column:
    """Baseline 0 without spike; a fixed value for the spike whose baseline is missing."""
    return (
        F.when(spike == F.lit(0.0), F.lit(fixed.UNSPIKED_BASELINE))
        .when((spike == F.lit(fixed.PATCHED_SPIKE)) & baseline.isNull(), F.lit(fixed.PATCHED_BASELINE))
        .otherwise(baseline)
    )


def _with_baseline(df: DataFrame, baseline: DataFrame) -> DataFrame:
    joined = null_safe_join(df, baseline, BASELINE_KEYS)
    return joined.withColumn("mean_spike_conc", patched_baseline(F.col("spike_ug_l"), F.col("mean_spike_conc")))


def with_spike_baseline(df: DataFrame) -> DataFrame:
    """Mean concentration of the spike vials of the same shore, month, analyte and dose."""
    spikes = filtered_mean(df, F.col("type") == fixed.SPIKE_TYPE, BASELINE_KEYS, "conc_ugn_l", "mean_spike_conc")
    return _with_baseline(df, settle(spikes, "spike-baseline"))


def with_rates(df: DataFrame) -> DataFrame:
    """Change since the baseline, and per hour."""
    return df.withColumn("delta_conc", F.col("conc_ugn_l") - F.col("mean_spike_conc")).withColumn(
        "delta_conc_hr", ratio("delta_conc", "real_icu_hrc")
    )


def _net_of_water(df: DataFrame, water: DataFrame, borrowed: dict[str, str] = fixed.BORROWED_CONTROL) -> DataFrame:
    assigned = df.withColumn("assigned_location", recode("location", borrowed))
    keys = [("assigned_location", "location"), "inc_month", "analyte", "mean_spike_conc"]
    joined = null_safe_join(assigned, water, keys)
    return joined.withColumn("net_delta_conc_hr", F.col("delta_conc_hr") - F.col("water_delta_conc_hr"))


def with_water_correction(df: DataFrame, borrowed: dict[str, str] = fixed.BORROWED_CONTROL) -> DataFrame:
    """Rate minus the mean rate of the water vials of the own or borrowed location.

    ``mean_spike_conc`` is a computed double used as a key: both sides take it
    from the same settled baseline table, so equal groups compare equal.
    """
    keys = ["inc_month", "location", "analyte", "mean_spike_conc"]
    water = filtered_mean(df, F.col("type") == fixed.WATER_TYPE, keys, "delta_conc_hr", "water_delta_conc_hr")
    return _net_of_water(df, settle(water, "water-control"), borrowed)


def control_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spike baselines and water rates from a single scan of the control vials.

    A water rate is (conc - baseline) / hours with one baseline per group, so
    its mean follows from the group's sums of conc / hours and 1 / hours, and
    the readings need not be joined to the baseline first.
    """
    per_hour = ratio(F.lit(1.0), "real_icu_hrc")
    sums = (
        df.filter(F.col("type").isin(fixed.SPIKE_TYPE, fixed.WATER_TYPE))
        .groupBy("type", "location", *BASELINE_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("conc_ugn_l").alias("conc"),
            F.count(per_hour).alias("n_timed"),
            F.sum(ratio("conc_ugn_l", "real_icu_hrc")).alias("conc_hr"),
            F.sum(per_hour).alias("per_hr"),
        )
    )
    with compiled_steps(df.sparkSession):
        sums = settle(sums, "control-sums")
    spikes = sums.filter(F.col("type") == fixed.SPIKE_TYPE).groupBy(*BASELINE_KEYS)
    baseline = settle(spikes.agg((F.sum("conc") / F.sum("n")).alias("mean_spike_conc")), "spike-baseline")
    waters = null_safe_join(sums.filter(F.col("type") == fixed.WATER_TYPE), baseline, BASELINE_KEYS)
    mean = patched_baseline(F.col("spike_ug_l"), F.col("mean_spike_conc"))
    rate = F.try_divide(F.sum(F.col("conc_hr") - F.col("mean_spike_conc") * F.col("per_hr")), F.sum("n_timed"))
    water = (
        waters.withColumn("mean_spike_conc", mean)
        .groupBy("inc_month", "location", "analyte", "mean_spike_conc")
        .agg(rate.alias("water_delta_conc_hr"))
    )
    return baseline, settle(water, "water-control")


def uptake_rates(readings: DataFrame, strict: bool = False, replicate_stats: bool = False) -> DataFrame:
    """Converted readings to the rate table of the substrates.

    Two scans: one of the control vials for both control tables, one of the
    substrate vials. Replicate means are not part of the rate table; ask for
    them to keep them.
    """
    df = clean_readings(readings, strict)
    baseline, water = control_tables(df)
    columns = list(RATE_COLUMNS)
    if replicate_stats:
        df = with_replicate_stats(df)
        columns += ["mean_conc", "sd_conc"]
    substrates = df.filter(F.col("type").isin(fixed.SUBSTRATE_TYPES))
    return _net_of_water(with_rates(_with_baseline(substrates, baseline)), water).select(*columns)
