"""One Spark query per operator or workflow, on the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries.bindings import (
    FITS,
    LAKE,
    LAKE_SHORE,
    READINGS,
    READINGS_LAST,
    READINGS_NEXT,
    select_list,
)
from limnokit import fixed_values as fixed
from limnokit.functions.clock import month_label, normal_clock, short_date, split_hours, with_incubation_hours
from limnokit.functions.numeric import (
    cfs_to_cms,
    is_in,
    label_rank,
    mg_to_ug,
    not_in,
    positive_ratio,
    ratio,
    recode,
    row_min,
    ug_to_mg,
)
from limnokit.functions.text import contains_text, leading_letters, paste, starts_with_any, without_text
from limnokit.operators.groups import (
    attach_mean_sd,
    conditional_shares,
    count_true,
    filtered_mean,
    global_mean,
    group_count,
    level_set,
    roll_up_share,
    value_range,
)
from limnokit.operators.histogram import histogram
from limnokit.operators.joins import attach_group_values, drop_listed, keep_listed, recode_from_table
from limnokit.operators.linear_fit import line_at, linear_fit
from limnokit.operators.loess import loess_curve
from limnokit.operators.order_stats import box_outliers, box_stats
from limnokit.operators.ordered import SEGMENT, in_segments, skip_head, with_previous, with_running_sum
from limnokit.operators.predict import predict_grid, saturation_at, trend_line
from limnokit.operators.profile import profile
from limnokit.operators.reshape import to_long
from limnokit.operators.saturation_fit import saturation_fit
from limnokit.plans.background import change_series, chemistry_long, discharge_series, on_dates, snow_series, temperature_profile
from limnokit.plans.catalogue import (
    fit_catalogue,
    incubation_counts,
    significance_roll_up,
    significance_shares,
)
from limnokit.plans.rates import clean_readings, limit_substituted, patched_baseline, uptake_rates, with_replicate_stats
from limnokit.plans.screening import (
    flag_by_rule_table,
    flag_report,
    flagged_rows,
    kept_rows,
    rate_figures,
    screen_outliers,
    uptake_metrics,
    with_normalised_rate,
    with_report_ranks,
    with_site_label,
    with_standardised_uptake,
)
from limnokit.plans.speciation import ammonia_fraction, convert_ammonium, shore_of
from limnokit.plans.workflows import MODEL_KEYS, fits_to_summary, rates_to_fits, smooth_temperature
from limnokit.session import compiled_steps, scratch_path, settle
from limnokit.sources.tables import read_bucketed, read_table, scan_csv, union_tables, write_bucketed, write_csv, write_parquet

FLAG_STATUS = ["l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- bindings ---------------------------------------------------------------


WORKFLOW_COLUMNS = [
    "inc_month", "location", "type", "analyte", "depth", "spike_ug_l", "actual_incubation_hrs", "volume_lake_water_l",
    "weight_g", "afdm_g", "site", "conc_mgn_l", "nh3_mgn_l", "no2_no3_mgn_l", "l_orderkey", "l_linenumber", "l_tax",
    "l_quantity",
]
SCREENING_COLUMNS = [
    "inc_month", "site", "type", "analyte", "spike_ug_l", "om_percent", "scatter", "l_orderkey", "l_linenumber",
]


def readings(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """lineitem as a table of raw vial readings."""
    base = table(spark, sf_dir, "lineitem").selectExpr(*select_list(READINGS))
    raw = base.selectExpr("*", *select_list(READINGS_NEXT)).selectExpr("*", *select_list(READINGS_LAST))
    return raw.select(*columns)


def lake_conditions(raw: DataFrame) -> DataFrame:
    keyed = raw.selectExpr(f"{LAKE_SHORE} AS shore", "inc_month", "l_quantity", "l_tax")
    return keyed.groupBy("shore", "inc_month").agg(*[F.expr(e).alias(n) for n, e in LAKE.items()])


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = readings(spark, sf_dir, WORKFLOW_COLUMNS)
    return convert_ammonium(raw, lake_conditions(raw))


def rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uptake_rates(converted(spark, sf_dir))


def rate_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a ready-made rate, some missing, for the screening queries."""
    raw = readings(spark, sf_dir, SCREENING_COLUMNS)
    return raw.withColumn("net_rate_om", F.when(F.col("om_percent") != 0, F.col("scatter") * 5000.0))


def orders_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def fit_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_nations(spark, sf_dir).selectExpr(*select_list(FITS))


def mm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rate = F.lit(900.0) * q / (F.lit(20.0) + q) + F.lit(1000.0) * (F.col("l_discount") - F.lit(0.05))
    return table(spark, sf_dir, "lineitem").select(*FLAG_STATUS, "l_quantity", rate.alias("rate"))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.hour("ts").cast("double").alias("hour"), "value")


# --- grouped fits -----------------------------------------------------------


def ols_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    fits = linear_fit(df, FLAG_STATUS, "l_quantity", "l_extendedprice", p_values=False)
    out = fits.select(
        *FLAG_STATUS, "n", "slope", "intercept", "se_slope", "se_intercept", "t_slope", "t_intercept", "df_resid"
    )
    return rounded(out, 4, "slope", "intercept", "se_slope", "se_intercept", "t_slope", "t_intercept")


def ols_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    fits = linear_fit(df, FLAG_STATUS, "l_quantity", "l_discount")
    return rounded(fits.select(*FLAG_STATUS, "n", "df_resid", "p_slope", "p_intercept"), 6, "p_slope", "p_intercept")


MM_COLUMNS = ["vmax", "km", "se_vmax", "se_km", "ci_low_km", "ci_high_km", "ci_low_vmax", "ci_high_vmax"]


def mm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = saturation_fit(mm_points(spark, sf_dir), FLAG_STATUS, "l_quantity", "rate", p_values=False)
    return rounded(fits.select(*FLAG_STATUS, "n", "n_doses", "df_resid", "status", *MM_COLUMNS), 4, *MM_COLUMNS)


def mm_fit_gauss_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = saturation_fit(
        mm_points(spark, sf_dir), FLAG_STATUS, "l_quantity", "rate", covariance="gauss_newton", p_values=False
    )
    return rounded(fits.select(*FLAG_STATUS, "vmax", "km", "se_vmax", "se_km"), 4, "vmax", "km", "se_vmax", "se_km")


def predict_grid_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = linear_fit(event_hours(spark, sf_dir), ["event_type"], "hour", "value", p_values=False)
    return rounded(predict_grid(fits, ["event_type"], line_at), 6, "x", "y")


def predict_grid_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = saturation_fit(mm_points(spark, sf_dir), FLAG_STATUS, "l_quantity", "rate", p_values=False)
    return rounded(predict_grid(fits, FLAG_STATUS, saturation_at), 4, "x", "y")


def trend_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return rounded(trend_line(df, ["l_returnflag"], "l_quantity", "l_extendedprice"), 3, "x", "y")


def loess_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(loess_curve(event_hours(spark, sf_dir), ["event_type"], "hour", "value"), 5, "x", "y")


# --- aggregates, joins, windows ---------------------------------------------


def group_stats_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FLAG_STATUS, "l_extendedprice")
    out = attach_mean_sd(df, FLAG_STATUS, "l_extendedprice", "mean_price", "sd_price")
    return rounded(out, 4, "mean_price", "sd_price")


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *FLAG_STATUS, "l_quantity", (F.col("l_extendedprice") / 997).alias("price")
    )
    keys = ["l_linestatus", "l_quantity"]
    base = filtered_mean(df, F.col("l_returnflag") == "R", keys, "price", "baseline")
    # Quantity 7 has no baseline of its own, so the fixed one is met
    out = attach_group_values(df, base.filter(F.col("l_quantity") != 7), keys, "baseline")
    dose = F.when(F.col("l_quantity") == 1, 0.0).when(F.col("l_quantity") == 7, 100.0).otherwise(F.col("l_quantity"))
    out = out.withColumn("baseline", patched_baseline(dose, F.col("baseline")))
    out = out.withColumn("delta", F.col("price") - F.col("baseline"))
    return rounded(out.withColumn("delta_per_unit", ratio("delta", "l_quantity")), 4, "baseline", "delta", "delta_per_unit")


def control_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    daily = settle(events.groupBy("day", "event_type").agg(F.avg("value").alias("daily_mean")), "daily")
    control = daily.select("day", "event_type", F.col("daily_mean").alias("control_mean"))
    assigned = daily.withColumn("assigned_type", recode("event_type", {"click": "view", "signup": "view"}))
    out = attach_group_values(assigned, control, ["day", ("assigned_type", "event_type")], "control")
    out = out.withColumn("net", F.col("daily_mean") - F.col("control_mean"))
    return rounded(out, 6, "daily_mean", "control_mean", "net")


def lod_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyte = recode("l_returnflag", {"A": "NH3", "R": "NO3"}, keep_unmatched=False)
    zero = F.lit(0.0)
    smaller = row_min(F.nullif(F.col("l_discount"), zero), F.nullif(F.col("l_tax"), zero))
    limits = {"nh3_limit": 0.02, "nh3_value": 0.001, "no3_limit": 0.03, "no3_value": 0.0015}
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        limit_substituted(smaller, analyte, **limits).alias("as_coded"),
        limit_substituted(smaller, analyte, strict=True, **limits).alias("by_own_limit"),
    )
    return df.filter(F.col("as_coded") > 0)


def hours_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "H:mm")
    clock = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "n/a").otherwise(text)
    df = table(spark, sf_dir, "events").select("event_id", clock.alias("clock"))
    out = df.select(
        "event_id", "clock", normal_clock("clock").alias("normal"), split_hours("clock").alias("split_hours")
    )
    return with_incubation_hours(out, "clock", "hours")


def speciation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = converted(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "shore", "inc_month", "analyte", "temp_deg_c", "ph", "nh4_mgn_l"
    )
    return rounded(out, 6, "temp_deg_c", "ph", "nh4_mgn_l")


def prefix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"E": ["ECON", "SMALL"], "L": ["PROMO"], "W": ["LARGE", "MED"]}
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        shore_of(F.nullif("p_type", F.lit("PROMO")), groups).alias("shore"),
        starts_with_any("p_brand", ["Brand#1", "Brand#2"]).alias("low_brand"),
    )


# --- screening --------------------------------------------------------------


def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = screen_outliers(rate_like(spark, sf_dir))
    return flagged.select("l_orderkey", "l_linenumber", "site", "flag")


def rule_table_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = "rate_lt double, rate_gt double, spike_eq double, spike_ne double"
    names = ["site", "inc_month", "type", "analyte", "rate_lt", "rate_gt", "spike_eq", "spike_ne"]
    rows = [tuple(rule.get(n) for n in names) for rule in fixed.OUTLIER_RULES]
    rules = spark.createDataFrame(rows, f"site string, inc_month string, type string, analyte string, {bounds}")
    flagged = flag_by_rule_table(rate_like(spark, sf_dir), rules)
    return flagged.select("l_orderkey", "l_linenumber", "site", "flag")


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_report(screen_outliers(rate_like(spark, sf_dir)))


def rule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = screen_outliers(rate_like(spark, sf_dir))
    names = {"flagged": flagged_rows(flagged), "kept": kept_rows(flagged)}
    parts = [df.select("site", "type", F.lit(part).alias("part")) for part, df in names.items()]
    return group_count(union_tables(parts), ["site", "type", "part"])


def depth_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.when(F.col("p_size") <= 15, 0.5).when(F.col("p_size") <= 30, 3.0).when(F.col("p_size") <= 45, 10.0)
    site = F.when(F.col("p_size") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit("_"))).otherwise(
        F.concat(F.lit("7"), F.col("p_brand"))
    )
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(depth, F.lit(99.0)).alias("depth"), without_text(site, "_").alias("site")
    )
    return with_site_label(df)


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("net_rate_om"),
        (F.nullif(F.col("l_quantity"), F.lit(2.0)) - 1).alias("mean_spike_conc"),
    )
    return with_standardised_uptake(df)


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_extendedprice").alias("net_delta_conc_hr"),
        F.col("l_quantity").alias("volume_lake_water_l"),
        F.col("l_tax").alias("afdm_g"),
        F.col("l_discount").alias("weight_g"),
    )
    long = uptake_metrics(with_normalised_rate(df))
    out = long.groupBy("l_returnflag", "metric").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("uptake").alias("n_values"), F.avg("uptake").alias("mean_uptake")
    )
    return rounded(out, 2, "mean_uptake")


# --- catalogue --------------------------------------------------------------


def model_key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = fit_like(spark, sf_dir)
    lines = fits.groupBy("model_name").agg(F.avg("vmax").alias("slope"))
    listed = ["BW0.5m_June_sediment_NO3", "GB10m_May_biofilm_NH3", "not_a_model"]
    cat = fit_catalogue(fits, settle(lines, "lines"), listed)
    out = cat.groupBy("site", "month", "substrate", "n_type", "site_id", "stream", "depth_loc").agg(
        F.count(F.lit(1)).alias("n"), F.avg("slope").alias("mean_slope")
    )
    return rounded(out, 3, "mean_slope")


def incubation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = fit_like(spark, sf_dir)
    lines = fits.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_lines"))
    return incubation_counts(fit_catalogue(fits, settle(lines, "lines")))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = fit_like(spark, sf_dir)
    return fit_catalogue(fits, settle(fits.select("model_name").distinct(), "lines"))


def sig_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance_shares(_catalogue(spark, sf_dir)), 8, "prop_mm_bothsig")


def sig_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance_roll_up(significance_shares(_catalogue(spark, sf_dir))), 8, "prop_sig")


def nation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_nations(spark, sf_dir)
    conditions = {
        "n_large": F.col("o_totalprice") > 250000,
        "n_urgent": F.nullif("o_orderpriority", F.lit("5-LOW")) == "1-URGENT",
    }
    shares = conditional_shares(df, ["n_name", "c_mktsegment"], conditions, "n_large", "share_large")
    coarse = roll_up_share(shares, ["n_name"], "n_large", "total", "sum_large", "sum_total", "share")
    return rounded(coarse, 8, "share")


# --- distributions ----------------------------------------------------------


def box_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = box_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


def box_stats_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite values and the ends of the double range among the events."""
    event, inf = F.col("event_id"), float("inf")
    value = F.col("value")
    for step, odd in reversed([(50, inf), (53, -inf), (59, 1.7e308), (61, -1.7e308)]):
        value = F.when(event % step == 0, F.lit(odd)).otherwise(value)
    out = box_stats(table(spark, sf_dir, "events").withColumn("value", value), ["event_type"], "value")
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


def box_outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_outliers(table(spark, sf_dir, "events"), ["event_type"], "value", carry=["event_id"])


def hist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    out = profile(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], quartiles=True)
    return rounded(out, 4, "mean", "sd", "min", "max", "q1", "median", "q3")


def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return value_range(df, "l_discount", FLAG_STATUS)


def keep_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").filter(is_in("l_returnflag", ["A", "R"]))
    return level_set(df, FLAG_STATUS)


def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    out = df.agg(
        F.avg(F.nullif("l_tax", F.lit(0.0))).alias("mean_tax"),
        count_true(F.nullif("l_tax", F.lit(0.0)) > 0.04).alias("n_high_tax"),
    )
    return rounded(out, 6, "mean_tax")


# --- series and chemistry ---------------------------------------------------


def daily_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    period = F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))
    daily = events.filter(period).groupBy("event_type", "day").agg(F.sum("value").alias("level"))
    # A gap from the 20th on in one series, so that its total is missing from there
    gap = (F.col("event_type") == "view") & (F.col("day") == F.lit("2024-01-20").cast("date"))
    daily = daily.withColumn("level", F.when(~gap, F.col("level")))
    out = change_series(daily, ["event_type"], "day", "level", slice_by=F.weekofyear("day"))
    return rounded(out, 4, "level", "daily_delta", "cumulative")


def previous_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two window operators by themselves, on every event of a user, in the segments of one range partitioning."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.nullif(F.floor("value"), F.lit(7)).cast("double").alias("v"))
    keyed, order = ["user_id"], ["ts", "event_id"]
    cut = in_segments(events, keyed, order)
    out = with_running_sum(with_previous(cut, keyed, order, "v", "previous", SEGMENT), keyed, order, "v", "total", SEGMENT)
    return out.select("event_id", "previous", "total")


def scaled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("discharge_cfs"))
    parts = []
    for kind, gauge in (("view", fixed.GAUGES["10336730"]), ("click", fixed.GAUGES["10336660"])):
        one = events.filter(F.col("event_type") == kind).withColumn("site", F.lit(gauge["site"]))
        one = one.withColumn("label", F.lit(gauge["label"])).withColumn("discharge_cms", cfs_to_cms("discharge_cfs"))
        parts.append(one.withColumn("scale_q", F.col("discharge_cms") / F.lit(gauge["area_km2"])))
    return union_tables(parts).drop("event_type")


def chem_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {"1-URGENT": "SH(NS)", "2-HIGH": "SS(NS)", "3-MEDIUM": "GB(NS)"}
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "M/d/yy").alias("date_text"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("site"),
        ug_to_mg("o_totalprice").alias("po4"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("doc"),
    )
    df = orders.filter(not_in("site", ["4-NOT SPECIFIED"])).withColumn(
        "position", recode("site", labels, keep_unmatched=False)
    )
    df = df.withColumn("date", short_date("date_text")).drop("date_text")
    long = to_long(df, ["o_orderkey", "site", "position", "date"], ["po4", "doc"], "variable", "concentration")
    return long.filter(F.col("concentration").isNotNull())


def month_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(
        month_label("o_orderdate").alias("month"),
        F.when(contains_text(F.nullif("o_orderpriority", F.lit("2-HIGH")), "HIGH"), "GB")
        .when(contains_text("o_orderpriority", "URGENT"), "GB")
        .otherwise("BW")
        .alias("color_group"),
        "o_totalprice",
    )
    df = df.filter(is_in("month", fixed.PROFILE_MONTHS)).withColumn(
        "month_rank", label_rank("month", fixed.MONTH_LABELS)
    )
    out = df.groupBy("month", "month_rank", "color_group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")
    )
    return rounded(out, 3, "mean_price")


def semi_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    return on_dates(events, "day", ["2024-01-05", "2024-01-16", "2024-01-25"])


def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers of one segment, the list being a table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    listed = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return keep_listed(orders, listed, "o_custkey").select("o_orderkey", "o_custkey")


def anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of all other customers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    listed = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return drop_listed(orders, listed, "o_custkey").select("o_orderkey", "o_custkey")


def recode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    labels = nation.filter(F.col("n_regionkey") < 2).select(
        "n_nationkey", F.concat(F.lit("near "), F.col("n_name")).alias("label")
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("place"))
    by_text = labels.select(F.col("n_nationkey").cast("string").alias("place"), "label")
    return recode_from_table(df, "place", by_text, "place_label")


def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.pow(F.lit(10.0), F.col("l_tax")), 8).alias("ten_power"),
        mg_to_ug("l_discount").alias("ug"),
        ug_to_mg("l_quantity").alias("mg"),
        cfs_to_cms("l_quantity").alias("cms"),
        F.round(ammonia_fraction("l_quantity", F.col("l_tax") * 100), 8).alias("fraction"),
        ratio("l_quantity", "l_tax").alias("per_tax"),
        positive_ratio("l_quantity", "l_discount").alias("per_discount"),
        (-F.col("l_quantity")).alias("negated"),
        F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(0.5)).alias("tax_or_default"),
        paste(F.nullif("l_returnflag", F.lit("N")), "l_linestatus", "l_linenumber", sep="_").alias("pasted"),
        leading_letters(F.concat("l_returnflag", F.lit("#"))).alias("letters"),
    )


def trim_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return skip_head(orders, ["o_orderstatus", "o_orderkey"], fixed.BLANK_HEAD_ROWS)


# --- the context series on renamed tables -------------------------------------


PERIOD = ("2024-01-05", "2024-01-25")


def discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauges = {"view": "10336730", "click": "10336660"}
    daily = table(spark, sf_dir, "events").select(
        recode("event_type", gauges).alias("site_no"), F.to_date("ts").alias("date"), F.col("value").alias("discharge_cfs")
    )
    return discharge_series(daily, start=PERIOD[0], end=PERIOD[1])


def snow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of three event types as two stations and one without a number."""
    station = F.when(F.col("event_type") == "view", 615).when(F.col("event_type") == "click", 848)
    daily = (
        table(spark, sf_dir, "events")
        .filter(is_in("event_type", ["view", "click", "error"]))
        .groupBy(station.cast("int").alias("site_id"), F.to_date("ts").alias("date"))
        .agg(F.sum("value").alias("snow_water_equivalent"))
    )
    return rounded(snow_series(daily, *PERIOD), 3, "snow_water_equivalent", "daily_delta", "cumulative")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a table of chemistry samples."""
    key, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    site = F.when(key % 6 == 0, F.lit(None).cast("string"))
    for left, name in enumerate(["GBL", "GBNS1", "BWO", "SSNS2"], 1):
        site = site.when(key % 6 == left, F.lit(name))
    return table(spark, sf_dir, "orders").select(
        key.alias("sample"),
        F.year("o_orderdate").alias("water_year"),
        site.otherwise(F.lit("elsewhere")).alias("site"),
        F.date_format("o_orderdate", "M/d/yy").alias("date"),
        F.when(status != "F", price).alias("po4_ugl_dl"),
        (price / 7).alias("no3_mgl_dl"),
        F.when(status == "F", price / 9).alias("nh4_mgl_dl"),
        (price / 11).alias("doc_mgl_dl"),
        price.alias("temp_c"),
    )


def chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = chemistry_long(samples(spark, sf_dir), 1995)
    out = long.select("sample", "site", "position", "date", "variable", "concentration", "y_limit", "position_rank")
    return rounded(out, 6, "concentration")


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temperature_profile(samples(spark, sf_dir), 1995)
    return out.select("sample", "month", "month_rank", "position", "color_group", "position_rank", "temp_c")


def temperature_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(smooth_temperature(temperature_profile(samples(spark, sf_dir), 1995)), 5, "x", "y")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers, flags and states as sites, months and metrics, ranked for reports."""
    labelled = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        recode("l_linenumber", {i + 1: x for i, x in enumerate(fixed.SITE_ORDER)}, keep_unmatched=False).alias("new_site"),
        recode("l_returnflag", dict(zip(["A", "N", "R"], fixed.INCUBATION_MONTHS))).alias("inc_month"),
        recode("l_linestatus", {"F": "raw_uptake", "O": "afdm_corrected"}).alias("metric"),
    )
    return with_report_ranks(labelled).drop("new_site", "inc_month", "metric")


def mean_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean decimal hours of clock texts."""
    clocks = table(spark, sf_dir, "events").select(split_hours(F.date_format("ts", "H:mm")).alias("hours"))
    return rounded(global_mean(clocks, "hours", "mean_hours"), 6, "mean_hours")


def snow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in another order of columns, with one column too many."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "view", F.col("value")).alias("snow_water_equivalent"),
        F.lit("beside").alias("note"),
        F.to_date("ts").alias("date"),
        F.col("event_id").cast("int").alias("site_id"),
    )


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "snow")
    write_csv(snow_table(spark, sf_dir), path)
    return read_table(spark, path, "snow_daily", "csv")


def lake_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """events as lake tables in two layouts: quotes and line feeds in texts, unreadable temperatures, a column too many."""
    event = F.col("event_id")
    shore = F.concat(F.lit('say "'), "event_type", F.lit('", line\n'), "user_id")
    warm = F.when(event % 10 == 3, "n.d.").otherwise((event % 40).cast("string"))
    named = table(spark, sf_dir, "events").select(
        "event_id", shore.alias("Shore"), event.cast("string").alias("Inc_month"), warm.alias("Temp_degC"), F.col("value").alias("pH"), F.lit("").alias("Note")
    )
    paths = [scratch_path(spark, "lake") for _ in range(2)]
    write_csv(named.filter(event % 2 == 0).select("Shore", "Inc_month", "Temp_degC", "pH"), paths[0])
    write_csv(named.filter(event % 2 == 1).select("pH", "Note", "Temp_degC", "Inc_month", "Shore"), paths[1])
    return paths


def csv_many_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, lake_files(spark, sf_dir), "lake_ph_temp", "csv")


def csv_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_csv(spark, lake_files(spark, sf_dir), "lake_ph_temp").faults


def parquet_hand_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "snow")
    write_parquet(snow_table(spark, sf_dir), path)
    return read_table(spark, path, "snow_daily")


def parquet_hand_off_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handed on by date, so that the next stage's daily sums need no exchange."""
    path = scratch_path(spark, "snow")
    write_bucketed(snow_table(spark, sf_dir).drop("note"), path, ["date"], 8)
    daily = read_bucketed(spark, path, "snow_daily", ["date"], 8).groupBy("date")
    return rounded(daily.agg(F.count(F.lit(1)).alias("n"), F.sum("snow_water_equivalent").alias("total")), 4, "total")


def rate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures' box statistics of readings with a ready-made rate."""
    raw = readings(spark, sf_dir, ["site", "inc_month", "analyte", "depth", "spike_ug_l", "scatter"])
    rates = raw.select("site", "inc_month", "analyte", "depth", F.col("spike_ug_l").alias("mean_spike_conc"), (F.col("scatter") * 5000.0).alias("net_rate_om"))
    out = rate_figures(rates).drop("metric_rank")
    return rounded(out, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


def replicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = readings(spark, sf_dir, ["site", "location", "inc_month", "type", "analyte", "spike_ug_l", "measured", "l_orderkey", "l_linenumber"])
    out = with_replicate_stats(raw.withColumnRenamed("measured", "conc_ugn_l"))
    return rounded(out.select("l_orderkey", "l_linenumber", "mean_conc", "sd_conc"), 6, "mean_conc", "sd_conc")


def mm_fit_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dose that hardly repeats: nearly as many doses as readings."""
    x = F.col("l_extendedprice").cast("double")
    rate = F.lit(900.0) * x / (F.lit(20000.0) + x) + F.lit(1000.0) * (F.col("l_discount") - F.lit(0.05))
    points = table(spark, sf_dir, "lineitem").select(*FLAG_STATUS, x.alias("x"), rate.alias("rate"))
    fits = saturation_fit(points, FLAG_STATUS, "x", "rate", p_values=False)
    return rounded(fits.select(*FLAG_STATUS, "n", "n_doses", "status", "vmax", "km", "se_vmax", "se_km"), 3, "vmax", "km", "se_vmax", "se_km")


def rule_table_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules for one key hold side by side."""
    bounds = "rate_lt double, rate_gt double, spike_eq double, spike_ne double"
    rules = [("A", 20000.0, None, None, None), ("A", None, 60000.0, None, 50.0), ("A", 20000.0, None, None, None), ("N", None, None, 7.0, None)]
    items = table(spark, sf_dir, "lineitem")
    table_ = spark.createDataFrame(rules, f"l_returnflag string, {bounds}")
    flagged = flag_by_rule_table(items, table_, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return flagged.select("l_orderkey", "l_linenumber", "l_returnflag", "flag")


def mm_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = saturation_fit(mm_points(spark, sf_dir), FLAG_STATUS, "l_quantity", "rate")
    return rounded(fits.select(*FLAG_STATUS, "p_vmax", "p_km"), 6, "p_vmax", "p_km")


def mm_fit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with no dose, one dose, few and many readings, failed ones kept."""
    line, x = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    grp = F.when(line == 1, "no dose").when(line == 2, "one dose").when((line == 3) & (F.col("l_orderkey") <= 2), "few").when(line != 3, "many")
    points = table(spark, sf_dir, "lineitem").select(
        grp.alias("grp"),
        F.when(line == 1, 0.0).when(line == 2, 5.0).otherwise(x).alias("x"),
        F.when(F.col("l_tax") != 0, 900 * x / (12 + x) + F.col("l_tax")).alias("y"),
    )
    fits = saturation_fit(points.filter("grp IS NOT NULL"), ["grp"], "x", "y", p_values=False, keep_failed=True)
    return fits.select("grp", "n", "n_excluded", "n_doses", "status")


# --- workflows --------------------------------------------------------------


def cleaned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_readings(converted(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "analyte", "conc_ugn_l", "real_icu_hrc"
    )
    return rounded(out, 5, "conc_ugn_l", "real_icu_hrc")


RATE_NUMBERS = [
    "mean_spike_conc", "nh4_mgn_l", "conc_ugn_l", "ph", "real_icu_hrc", "delta_conc", "delta_conc_hr",
    "water_delta_conc_hr", "net_delta_conc_hr",
]


def uptake_rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rate_table(spark, sf_dir), 5, *RATE_NUMBERS)


def kept_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate table, normalised and screened."""
    return kept_rows(screen_outliers(with_normalised_rate(rate_table(spark, sf_dir))))


def incubation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = linear_fit(kept_rates(spark, sf_dir), MODEL_KEYS, "mean_spike_conc", "net_rate_om", p_values=False)
    with compiled_steps(spark):
        fits = settle(fits, "lines")
    out = fits.select(*MODEL_KEYS, "n", "intercept", "slope", "se_intercept", "se_slope", "df_resid", "status")
    return rounded(out, 6, "intercept", "slope", "se_intercept", "se_slope")


def incubation_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = saturation_fit(kept_rates(spark, sf_dir), MODEL_KEYS, "mean_spike_conc", "net_rate_om", p_values=False)
    out = fits.select(*MODEL_KEYS, "n", "n_doses", "vmax", "km", "se_vmax", "se_km", "status")
    return rounded(out, 3, "vmax", "km", "se_vmax", "se_km")


def saturating_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = rates_to_fits(rate_table(spark, sf_dir))
    return rounded(fits_to_summary(fits.saturation, fits.linear).roll_up, 8, "prop_sig")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ols_by_group": ols_by_group,
    "ols_pvalues": ols_pvalues,
    "mm_fit": mm_fit,
    "mm_fit_gauss_newton": mm_fit_gauss_newton,
    "predict_grid": predict_grid_line,
    "predict_grid_curve": predict_grid_curve,
    "trend_line": trend_by_type,
    "loess_grid": loess_grid,
    "group_stats_attach": group_stats_attach,
    "baseline_delta": baseline_delta,
    "control_correct": control_correct,
    "lod_substitute": lod_substitute,
    "hours_clean": hours_clean,
    "speciation": speciation,
    "prefix_class": prefix_class,
    "rule_flag": rule_flags,
    "rule_table_flag": rule_table_flags,
    "rule_report": rule_report,
    "rule_split": rule_split,
    "depth_zone": depth_zone,
    "standardised": standardised,
    "metrics_long": metrics_long,
    "model_key_split": model_key_split,
    "incubation_count": incubation_count,
    "sig_share": sig_share,
    "sig_rollup": sig_rollup,
    "nation_share": nation_share,
    "box_stats": box_by_type,
    "box_outliers": box_outlier_rows,
    "hist_bins": hist_bins,
    "profile": column_profile,
    "value_range": price_range,
    "keep_distinct": keep_distinct,
    "global_counts": global_counts,
    "daily_delta": daily_delta,
    "previous_and_total": previous_and_total,
    "scaled_union": scaled_union,
    "chem_long": chem_long,
    "month_profile": month_profile,
    "semi_dates": semi_dates,
    "semi_keys": semi_keys,
    "anti_keys": anti_keys,
    "recode_table": recode_table,
    "scalar_math": scalar_math,
    "trim_head": trim_head,
    "cleaned_readings": cleaned_readings,
    "uptake_rate_table": uptake_rate_table,
    "incubation_lines": incubation_lines,
    "incubation_curves": incubation_curves,
    "saturating_share": saturating_share,
    "box_stats_nonfinite": box_stats_nonfinite,
    "mm_pvalues": mm_pvalues,
    "mm_fit_status": mm_fit_status,
    "discharge": discharge,
    "snow": snow,
    "chemistry": chemistry,
    "temperature": temperature,
    "temperature_smooth": temperature_smooth,
    "report_order": report_order,
    "mean_hours": mean_hours,
    "csv_round_trip": csv_round_trip,
    "csv_many_layouts": csv_many_layouts,
    "csv_faults": csv_faults,
    "parquet_hand_off": parquet_hand_off,
    "parquet_hand_off_bucketed": parquet_hand_off_bucketed,
    "rate_figures": rate_boxes,
    "replicate_stats": replicate_stats,
    "mm_fit_continuous": mm_fit_continuous,
    "rule_table_overlap": rule_table_overlap,
}
