import csv
import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.plans import background, catalogue, rates, screening, speciation, workflows
from limnokit.sources.schemas import table_schema
from limnokit.sources.tables import read_table


def readings(spark, *overrides):
    """Raw readings, each a default reading with some fields replaced."""
    base = {
        "sample_date": dt.date(2023, 5, 24), "inc_month": "May", "site": "GB3m", "location": "GB", "vial_num": 1,
        "type": "sediment", "analyte": "NO3", "depth": 3.0, "spike_ug_l": 100.0, "nh3_spike_ug_l": None,
        "no3_spike_ug_l": None, "conc_mgn_l": None, "nh3_mgn_l": None, "no2_no3_mgn_l": 0.05,
        "actual_incubation_hrs": "6:30", "volume_lake_water_l": 0.1, "weight_g": 2.0, "afdm_g": 0.5, "om_percent": 1.0,
    }
    schema = table_schema("incubation_raw")
    return spark.createDataFrame([tuple({**base, **o}[f.name] for f in schema) for o in overrides], schema)


def lake(spark, *extra):
    data = [("E", "May", 15.0, 8.0), ("W", "May", 12.0, 7.5), *extra]
    return spark.createDataFrame(data, table_schema("lake_ph_temp"))


def test_shore_labels(spark):
    df = spark.createDataFrame([("GB",), ("SH3",), ("DI_blank",), ("DI",), ("BW",), ("SS",), (None,)], "l string")
    assert [r[0] for r in df.select(speciation.shore_of("l")).collect()] == ["E", "E", "L", None, "W", "W", None]


def test_ammonium_only_on_ammonia_rows(spark):
    raw = readings(
        spark,
        {"vial_num": 1, "analyte": "NH3", "conc_mgn_l": 0.2},
        {"vial_num": 2, "analyte": "NO3", "conc_mgn_l": 0.2},
        {"vial_num": 3, "analyte": "NH3", "conc_mgn_l": 0.2, "location": "XX"},
        {"vial_num": 4, "analyte": "NH3", "conc_mgn_l": 0.2, "inc_month": ""},
    )
    got = {r.vial_num: r for r in speciation.convert_ammonium(raw, lake(spark)).collect()}
    pka = 0.09018 + 2727.92 / (15 + 273.15)
    assert got[1].nh4_mgn_l == pytest.approx((1 - 1 / (10 ** (pka - 8.0) + 1)) * 0.2)
    assert got[2].nh4_mgn_l is None and got[3].nh4_mgn_l is None
    assert got[3].shore is None and 4 not in got
    # A lake row without a shore serves readings without one
    with_null = lake(spark, (None, "May", 15.0, 8.0))
    got = {r.vial_num: r for r in speciation.convert_ammonium(raw, with_null).collect()}
    assert got[3].nh4_mgn_l == pytest.approx(got[1].nh4_mgn_l)


def test_lake_row_at_absolute_zero_is_no_error(spark):
    """Readings that do not meet it are converted; those that do have no ammonium."""
    raw = readings(spark, {"vial_num": 1, "analyte": "NH3", "conc_mgn_l": 0.2}, {"vial_num": 2, "analyte": "NH3", "conc_mgn_l": 0.2, "inc_month": "July"})
    got = {r.vial_num: r for r in speciation.convert_ammonium(raw, lake(spark, ("E", "July", -273.15, 8.0))).collect()}
    assert got[1].nh4_mgn_l > 0 and got[2].nh4_mgn_l is None and "__ionised" not in got[1]


def test_blank_head_by_position(spark):
    raw = readings(spark, *[{"inc_month": m, "vial_num": i} for i, m in enumerate(["May", "", "", "June", "May"])])
    got = speciation.convert_ammonium(raw, lake(spark), skip_rows=2)
    assert sorted(r.vial_num for r in got.collect()) == [0, 3, 4]


@pytest.mark.parametrize(
    "analyte,conc,coded,strict",
    [
        ("NO3", 0.001, 0.001, 0.0015),
        ("NO3", 0.002, 0.0015, 0.0015),
        ("NO3", 0.003, 0.003, 0.003),
        ("NH3", 0.0015, 0.001, 0.001),
        ("NH3", -0.5, 0.001, 0.001),
        ("NH3", 0.0025, 0.0025, 0.0025),
        ("NO3", -0.5, -0.5, 0.0015),
        ("NO3", None, None, None),
        (None, 0.001, None, 0.001),
        (None, 0.0025, 0.0025, 0.0025),
    ],
)
def test_detection_limits(spark, analyte, conc, coded, strict):
    df = spark.createDataFrame([(analyte, conc)], "a string, c double")
    got = df.select(
        rates.limit_substituted(F.col("c"), F.col("a")), rates.limit_substituted(F.col("c"), F.col("a"), strict=True)
    ).first()
    assert tuple(got) == (coded, strict)


def rate_inputs(spark):
    return readings(
        spark,
        {"vial_num": 1, "type": "spike", "no2_no3_mgn_l": 0.100},
        {"vial_num": 2, "type": "spike", "no2_no3_mgn_l": 0.120},
        {"vial_num": 3, "type": "water", "no2_no3_mgn_l": 0.097, "actual_incubation_hrs": "6:30"},
        {"vial_num": 4, "type": "sediment", "no2_no3_mgn_l": 0.045},
        {"vial_num": 5, "type": "sediment", "no2_no3_mgn_l": 0.045, "location": "SH", "site": "SH3m"},
        {"vial_num": 6, "type": "sediment", "no2_no3_mgn_l": 0.045, "spike_ug_l": 0.0},
        {"vial_num": 7, "type": "sediment", "no2_no3_mgn_l": 0.045, "location": "BW", "site": "BW3m"},
        {"vial_num": 8, "type": "biofilm", "no2_no3_mgn_l": 0.045, "spike_ug_l": 400.0},
        {"vial_num": 9, "type": "biofilm", "no2_no3_mgn_l": -0.045},
        {"vial_num": 10, "type": "biofilm", "no2_no3_mgn_l": None},
        {"vial_num": 11, "type": "water", "no2_no3_mgn_l": 0.004, "spike_ug_l": 0.0, "depth": 10.0},
    )


def test_uptake_rates(spark):
    df = speciation.convert_ammonium(rate_inputs(spark), lake(spark))
    out = rates.uptake_rates(df)
    assert out.columns == rates.RATE_COLUMNS
    got = {(r.location, r.type, r.spike_ug_l): r for r in out.collect()}
    assert len(got) == out.count() == 5
    own = got[("GB", "sediment", 100.0)]
    water = (97.0 - 110.0) / 6.5
    assert own.mean_spike_conc == pytest.approx(110.0)
    assert own.delta_conc == pytest.approx(45.0 - 110.0)
    assert own.water_delta_conc_hr == pytest.approx(water)
    assert own.net_delta_conc_hr == pytest.approx((45.0 - 110.0) / 6.5 - water)
    borrowed = got[("SH", "sediment", 100.0)]
    assert borrowed.water_delta_conc_hr == pytest.approx(water)
    unspiked = got[("GB", "sediment", 0.0)]
    assert unspiked.mean_spike_conc == 0.0 and unspiked.water_delta_conc_hr == pytest.approx(4.0 / 6.5)
    patched = got[("BW", "sediment", 100.0)]
    assert patched.mean_spike_conc == 117.5 and patched.net_delta_conc_hr is None
    missing = got[("GB", "biofilm", 400.0)]
    assert missing.mean_spike_conc is None and missing.delta_conc_hr is None


def test_replicate_stats_do_not_change_the_rates(spark):
    df = speciation.convert_ammonium(rate_inputs(spark), lake(spark))
    plain, wide = rates.uptake_rates(df), rates.uptake_rates(df, replicate_stats=True)
    assert wide.columns == [*rates.RATE_COLUMNS, "mean_conc", "sd_conc"]
    assert rows(wide.drop("mean_conc", "sd_conc")) == rows(plain)


def test_control_tables_agree_with_the_single_steps(spark):
    more = [
        {"type": "water", "no2_no3_mgn_l": 0.09 + i / 1000, "spike_ug_l": s, "depth": d, "location": loc, "actual_incubation_hrs": h}
        for i, (s, d, loc, h) in enumerate(
            [(100.0, 3.0, "GB", "6:10"), (100.0, 10.0, "GB", "7:20"), (0.0, 3.0, "GB", "0:00"), (0.0, 3.0, "BW", "bad"),
             (100.0, 3.0, "BW", "6:00"), (400.0, 3.0, "GB", "6:00"), (0.0, 3.0, "GB", "6:00")]
        )
    ]
    raw = rate_inputs(spark).unionByName(readings(spark, *more))
    df = rates.clean_readings(speciation.convert_ammonium(raw, lake(spark)))
    steps = rates.with_water_correction(rates.with_rates(rates.with_spike_baseline(df)))
    steps = steps.filter(F.col("type").isin("biofilm", "sediment")).select("vial_num", *rates.RATE_COLUMNS)
    baseline, water = rates.control_tables(df)
    direct = rates.uptake_rates(speciation.convert_ammonium(raw, lake(spark)))
    for a, b in zip(rows(steps.drop("vial_num")), rows(direct)):
        assert a == pytest.approx(b) if None not in a else [x for x in a if x is None] == [x for x in b if x is None]
    by_step = df.transform(rates.with_spike_baseline).transform(rates.with_rates).filter("type = 'water'")
    want = by_step.groupBy("inc_month", "location", "analyte", "mean_spike_conc").agg(F.avg("delta_conc_hr").alias("w"))
    want = {tuple(r[:4]): r.w for r in want.collect()}
    got = {(r.inc_month, r.location, r.analyte, r.mean_spike_conc): r.water_delta_conc_hr for r in water.collect()}
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {
        k: v if v is None else round(v, 9) for k, v in want.items()
    }


def test_spike_zero_groups_share_one_control(spark):
    """Unspiked rows of either shore have baseline 0, so their water controls pool by location."""
    df = readings(
        spark,
        {"type": "water", "spike_ug_l": 0.0, "no2_no3_mgn_l": 0.0065, "depth": 3.0},
        {"type": "water", "spike_ug_l": 0.0, "no2_no3_mgn_l": 0.0130, "depth": 10.0, "site": "GB10m"},
        {"type": "sediment", "spike_ug_l": 0.0, "no2_no3_mgn_l": 0.0130},
    )
    r = rates.uptake_rates(speciation.convert_ammonium(df, lake(spark))).first()
    assert r.water_delta_conc_hr == pytest.approx(1.5) and r.net_delta_conc_hr == pytest.approx(0.5)


def rule_cases(spark):
    data = [
        ("BW0.5m", "July", "biofilm", "NH3", -1.0, 100.0),
        ("BW0.5m", "July", "biofilm", "NH3", None, 100.0),
        ("BW0.5m", "July", "biofilm", "NH3", 1.0, 100.0),
        ("BW0.5m", "July", "sediment", "NO3", -1.0, 0.0),
        ("BW0.5m", "July", "sediment", "NO3", -1.0, 100.0),
        ("BW10m", "June", "sediment", "NO3", None, 800.0),
        ("GB3m", "June", "sediment", "NO3", -49.0, 800.0),
        ("GB_3m", "June", "sediment", "NO3", -99.0, 800.0),
        ("GB3m", "June", "biofilm", "NO3", None, None),
        (None, "July", "biofilm", "NH3", -1.0, 100.0),
    ]
    names = "site string, inc_month string, type string, analyte string, net_rate_om double, spike_ug_l double"
    want = [True, None, False, False, True, True, False, False, False, None]
    return spark.createDataFrame(data, names).coalesce(1), want


def test_rule_flag_is_three_valued(spark):
    df, want = rule_cases(spark)
    flagged = screening.screen_outliers(df)
    assert [r.flag for r in flagged.collect()] == want
    assert screening.flagged_rows(flagged).count() == 3
    kept = screening.kept_rows(flagged)
    assert kept.count() == 5 and kept.filter("site = 'GB3m'").count() == 3
    assert screening.flag_total(flagged).first()[0] == 3
    assert screening.flag_report(flagged).agg(F.sum("filtered_count")).first()[0] == 3


def test_rule_table_gives_the_same_flag(spark):
    df, want = rule_cases(spark)
    names = [*screening.RULE_KEYS, *screening.BOUNDS]
    ddl = "site string, inc_month string, type string, analyte string, " + ", ".join(f"{b} double" for b in screening.BOUNDS)
    rules = spark.createDataFrame([tuple(r.get(n) for n in names) for r in fixed.OUTLIER_RULES], ddl)
    numbered = df.withColumn("i", F.monotonically_increasing_id())
    assert [r.flag for r in screening.flag_by_rule_table(numbered, rules).orderBy("i").collect()] == want


def test_overlapping_rules_are_ored(spark):
    key = {"site": "a", "inc_month": "May", "type": "t", "analyte": "n"}
    df = spark.createDataFrame([("a", "May", "t", "n", 5.0, None)], "site string, inc_month string, type string, analyte string, net_rate_om double, spike_ug_l double")
    either = screening.rule_flag([{**key, "spike_eq": 1.0}, {**key, "rate_gt": 4.0}])
    assert df.select(either).first()[0] is True
    unknown = screening.rule_flag([{**key, "spike_eq": 1.0}, {**key, "rate_gt": 6.0}])
    assert df.select(unknown).first()[0] is None


def test_normalisation_and_metrics(spark):
    df = spark.createDataFrame([(-2.0, 0.5, 0.25, 4.0), (-2.0, 0.5, 0.0, 0.0)], "net_delta_conc_hr double, volume_lake_water_l double, afdm_g double, weight_g double")
    out = screening.with_normalised_rate(df)
    assert [r.net_rate_om for r in out.collect()] == [4.0, None]
    long = {(r.afdm_g, r.metric): r.uptake for r in screening.uptake_metrics(out).collect()}
    assert long == {
        (0.25, "raw_uptake"): 2.0, (0.25, "weight_corrected"): 0.5, (0.25, "afdm_corrected"): 4.0,
        (0.0, "raw_uptake"): 2.0, (0.0, "weight_corrected"): None, (0.0, "afdm_corrected"): None,
    }


def test_site_labels_and_standardised_uptake(spark):
    df = spark.createDataFrame([("GB3m", 3.0), ("BW1m", 1.0), ("7x", 10.0)], "site string, depth double")
    assert [r.new_site for r in screening.with_site_label(df).collect()] == ["GBNS", "BWNA", "NASL"]
    df = spark.createDataFrame([(6.0, 0.0), (6.0, 3.0), (6.0, None), (6.0, -2.0)], "net_rate_om double, mean_spike_conc double")
    got = [(r.is_control, r.standardized_uptake) for r in screening.with_standardised_uptake(df).collect()]
    assert got == [("control", None), ("spiked", 2.0), (None, None), ("spiked", None)]


def fit_tables(spark):
    mm = spark.createDataFrame(
        [
            ("BW3m_May_sediment_NH3", 0.01, 0.02),
            ("BW3m_July_sediment_NH3", 0.01, 0.5),
            ("BW3m_July_sediment_NO3", None, 0.01),
            ("SS3m_May_sediment_NO3", None, None),
            ("ZZ1m_May_sediment_NO3", 0.01, 0.01),
        ],
        "model_name string, p_value_vmax double, p_value_km double",
    )
    lin = spark.createDataFrame([("BW3m_May_sediment_NH3", 2.0)], "model_name string, slope double")
    return mm, lin


def test_fit_catalogue_and_shares(spark):
    cat = catalogue.fit_catalogue(*fit_tables(spark))
    got = {r.model_name: (r.stream, r.depth_loc, r.slope) for r in cat.collect()}
    assert got == {
        "BW3m_May_sediment_NH3": ("BW", "NS", 2.0),
        "BW3m_July_sediment_NH3": ("BW", "NS", None),
        "BW3m_July_sediment_NO3": ("BW", "NS", None),
        "ZZ1m_May_sediment_NO3": ("ZZ1m", None, None),
    }
    shares = catalogue.significance_shares(cat)
    assert ("BW", "NS", "sediment", "NH3", 2, 2, 1, 1, 0.5) in rows(shares)
    assert ("BW", "NS", "sediment", "NO3", 1, 0, 1, 0, 0.0) in rows(shares)
    labels = {r.model_name: (r.vmax_sig, r.vmax_km_sig) for r in catalogue.with_significance(cat).collect()}
    assert labels["BW3m_July_sediment_NO3"] == (None, None)
    assert ("BW", "sediment", "NH3", 2, 1, 0.5) in rows(catalogue.significance_roll_up(shares))
    assert catalogue.fit_catalogue(*fit_tables(spark), excluded=[]).count() == 5


def published(published_dir, column):
    """Path of the published table that has a column."""
    for path in sorted(published_dir.glob("*.csv")):
        with open(path, newline="") as f:
            if column in next(csv.reader(f)):
                return str(path)
    pytest.skip(f"no table with {column}")


# Expected shares: stream, zone, substrate, analyte, total, Vmax, Km and both significant
SHARES = """
BW INT biofilm NH3 3 2 2 2
BW INT biofilm NO3 3 2 1 1
BW INT sediment NH3 3 2 2 2
BW INT sediment NO3 1 0 0 0
BW NS sediment NH3 3 2 2 2
BW NS sediment NO3 2 1 0 0
BW SL sediment NH3 3 2 2 2
BW SL sediment NO3 3 2 1 1
GB INT biofilm NH3 2 1 0 0
GB INT biofilm NO3 2 2 0 0
GB INT sediment NH3 2 0 0 0
GB NS sediment NH3 3 1 1 1
GB NS sediment NO3 3 3 1 1
GB SL sediment NH3 3 3 2 2
GB SL sediment NO3 3 3 1 1
SH NS sediment NH3 3 1 1 1
SH NS sediment NO3 3 3 1 1
SS NS sediment NH3 3 3 3 3
SS NS sediment NO3 2 2 2 2
"""
ROLL_UP = """
BW biofilm NH3 3 2
BW biofilm NO3 3 1
BW sediment NH3 9 6
BW sediment NO3 6 1
GB biofilm NH3 2 0
GB biofilm NO3 2 0
GB sediment NH3 8 3
GB sediment NO3 6 2
SH sediment NH3 3 1
SH sediment NO3 3 1
SS sediment NH3 3 3
SS sediment NO3 2 2
"""


def test_published_fits_to_summary(spark, published_dir):
    mm = read_table(spark, published(published_dir, "Std_Error_Km"), "fit_mm", "csv")
    lin = read_table(spark, published(published_dir, "Std_Error_slope"), "fit_linear", "csv")
    assert mm.count() == 59 and lin.count() == 60 and mm.filter("p_value_km is null").count() == 1
    summary = workflows.fits_to_summary(mm, lin)
    counts = read_table(spark, published(published_dir, "Depth_Loc"), "fit_summary", "csv")
    assert rows(summary.counts) == rows(counts) and summary.catalogue.count() == 50
    want = [line.split() for line in SHARES.split("\n") if line]
    got = [tuple(map(str, r[:8])) for r in summary.shares.collect()]
    assert sorted(got) == sorted(map(tuple, want))
    want = [line.split() for line in ROLL_UP.split("\n") if line]
    assert sorted(tuple(map(str, r[:5])) for r in summary.roll_up.collect()) == sorted(map(tuple, want))


def test_published_p_values(spark, published_dir):
    from limnokit.functions.tdist import two_sided_p

    checked = 0
    tables = [("Std_Error_slope", "fit_linear", ["slope", "intercept"], 1e-10), ("Std_Error_Km", "fit_mm", ["vmax", "km"], 0)]
    for column, table, names, rel in tables:
        df = read_table(spark, published(published_dir, column), table, "csv").select(
            F.explode(F.array(*[F.struct(F.col(n).alias("est"), F.col(f"std_error_{n}").alias("se"), F.col(f"p_value_{n}").alias("p")) for n in names])).alias("c"),
            F.explode(F.sequence(F.lit(8), F.lit(20))).alias("df"),
        ).filter("c.p is not null")
        got = df.select("c.*", "df", two_sided_p(F.col("c.est") / F.col("c.se"), "df").alias("mine"))
        best = got.groupBy("est", "se", "p").agg(F.min(F.abs(F.col("mine") - F.col("p"))).alias("gap"))
        for r in best.collect():
            assert r.gap <= max(rel * r.p, 1e-12 if rel == 0 else 0.0) or r.gap <= 1e-9 * r.p
            checked += 1
    assert checked == 236


def test_rates_to_fits_columns_and_keys(spark):
    data = [
        (site, "May", "sediment", "NO3", dose, dose, -(30 * dose / (100 + dose)) + 0.3 * (k - 1), 1.0, 1.0)
        for site in ("GB_3m", "SH3m") for dose in (0.0, 100.0, 200.0, 400.0, 600.0) for k in range(3)
    ]
    ddl = "site string, inc_month string, type string, analyte string, spike_ug_l double, mean_spike_conc double, net_delta_conc_hr double, volume_lake_water_l double, afdm_g double"
    fits = workflows.rates_to_fits(spark.createDataFrame(data, ddl))
    got = {r.model_name: r for r in fits.saturation.collect()}
    # The GB site is matched to its rules before the underscore is taken out
    assert set(got) == {"GB3m_May_sediment_NO3", "SH3m_May_sediment_NO3"}
    assert got["GB3m_May_sediment_NO3"].vmax == pytest.approx(30, rel=0.05)
    assert {r.model_name for r in fits.linear.collect()} == set(got)
    summary = workflows.fits_to_summary(fits.saturation, fits.linear)
    assert rows(summary.roll_up) == [("GB", "sediment", "NO3", 1, 1, 1.0), ("SH", "sediment", "NO3", 1, 1, 1.0)]


def test_readings_to_rates_unions_months(spark):
    one = rate_inputs(spark)
    out = workflows.readings_to_rates([one.filter("vial_num < 4"), one.filter("vial_num >= 4")], lake(spark))
    assert out.count() == 5


def test_discharge_series(spark):
    d = dt.date(2023, 1, 1)
    data = [("10336730", d, 10.0), ("10336660", d, 10.0), ("999", d, 1.0), ("10336730", dt.date(2023, 9, 2), 1.0)]
    daily = spark.createDataFrame(data, table_schema("discharge_daily"))
    got = {r.site: r for r in background.discharge_series(daily).collect()}
    assert set(got) == {"GB", "BW"}
    assert got["GB"].label == "east" and got["GB"].discharge_cms == pytest.approx(0.283168)
    assert got["BW"].scale_q == pytest.approx(0.283168 / 29.00787)
    east = background.gauge_discharge(daily.filter("site_no = '10336730'"), "GB", "east", 10.64485)
    assert east.columns == ["date", "discharge_cfs", "site", "label", "discharge_cms", "scale_q"]


def test_snow_series(spark):
    days = [dt.date(2023, 1, 30) + dt.timedelta(days=i) for i in range(5)]
    levels = {615: [10.0, 12.0, 12.0, 9.0, None], 848: [0.0, 1.0, None, 2.0, 3.0]}
    data = [(s, d, v) for s, vs in levels.items() for d, v in zip(days, vs)]
    data.append((615, dt.date(2022, 12, 31), 99.0))
    daily = spark.createDataFrame(data, table_schema("snow_daily"))
    got = {}
    for r in background.snow_series(daily).orderBy("date").collect():
        got.setdefault(r.site, []).append((r.daily_delta, r.cumulative, r.quality, r.rain))
    assert got["GB"] == [
        (10.0, 10.0, "Accumulate", 0), (2.0, 12.0, "Accumulate", 0), (0.0, 12.0, "Melt", 0), (-3.0, 9.0, "Melt", 1),
        (None, None, None, None),
    ]
    assert got["BW"][2:] == [(None, None, None, None), (None, None, None, None), (1.0, None, "Accumulate", 0)]
    assert background.on_dates(daily, "date", ["2023-01-31"]).count() == 2


def chemistry(spark):
    data = [
        (2023, "GBNS1", "5/24/23", 5.0, 0.1, None, 2.0, 10.0),
        (2023, None, "6/26/23", 5.0, 0.1, 0.2, 2.0, 11.0),
        (2023, "GBL", "6/26/23", 5.0, 0.1, 0.2, 2.0, 12.0),
        (2023, "BWO", "10/1/22", None, None, None, 3.0, 13.0),
        (2022, "BWO", "7/1/22", 5.0, 0.1, 0.2, 2.0, 14.0),
        (2023, "XX", "7/21/23", 1.0, None, None, None, 15.0),
    ]
    return spark.createDataFrame(data, table_schema("chemistry"))


def test_chemistry_long(spark):
    out = background.chemistry_long(chemistry(spark)).collect()
    assert len(out) == 3 + 4 + 1 + 1
    first = {r.variable: r for r in out if r.site == "GBNS1"}
    assert first["po4_mgl_dl"].concentration == 0.005 and first["po4_mgl_dl"].position == "GB(NS)"
    assert first["doc_mgl_dl"].y_limit == 5.0 and first["no3_mgl_dl"].y_limit == 0.125
    assert first["doc_mgl_dl"].date == dt.date(2023, 5, 24) and first["doc_mgl_dl"].position_rank == 3
    unplaced = [r for r in out if r.site is None]
    assert len(unplaced) == 4 and unplaced[0].position is None and unplaced[0].position_rank is None


def test_temperature_profile(spark):
    got = background.temperature_profile(chemistry(spark)).collect()
    # October is a label but not reported; unplaced sites are left out
    assert [(r.site, r.month, r.month_rank, r.color_group, r.position_rank) for r in got] == [("GBNS1", "May", 5, "GB", 3)]


def test_rate_figures_and_context(spark):
    data = [("BW0.5m", 0.5, "May", "NO3", dose, float(v)) for dose in (0.0, 100.0) for v in range(1, 6)]
    df = spark.createDataFrame(data, "site string, depth double, inc_month string, analyte string, mean_spike_conc double, net_rate_om double")
    (r,) = screening.rate_figures(df).collect()
    assert (r.new_site, r.n, r.q1, r.median, r.q3, r.month_rank) == ("BWINT", 5, 2.0, 3.0, 4.0, 1)
    assert r.site_rank == 1
    day = dt.date(2023, 1, 1)
    discharge = spark.createDataFrame([("10336730", day, 10.0)], table_schema("discharge_daily"))
    snow = spark.createDataFrame([(615, day, 1.0), (615, dt.date(2023, 1, 2), 3.0)], table_schema("snow_daily"))
    samples = [(2023, "GBNS1", f"{m}/5/23", 1.0, 0.1, None, 2.0, float(m)) for m in range(1, 10)]
    context = workflows.context_series(discharge, snow, spark.createDataFrame(samples, table_schema("chemistry")))
    assert context.discharge.count() == 1 and context.chemistry.count() == 27 and context.temperature.count() == 9
    assert [r.cumulative for r in context.snow.orderBy("date").collect()] == [1.0, 3.0]
    assert all(abs(r.y - r.x) < 1e-9 for r in context.temperature_curve.collect())
