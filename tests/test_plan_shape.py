"""What the physical plans must keep: pruned scans, pushed filters, few shuffles."""

import datetime as dt
import re
from pathlib import Path

import pytest

from limnokit.operators import doses
from limnokit.operators.groups import attach_mean_sd
from limnokit.operators.linear_fit import linear_fit
from limnokit.operators.order_stats import box_stats
from limnokit.operators.ordered import skip_head
from limnokit.operators.profile import profile
from limnokit.operators.saturation_fit import _grid_round, compact_doses, saturation_fit
from limnokit.plans import rates as rate_plans
from limnokit.plans.background import discharge_series
from limnokit.plans.rates import uptake_rates
from limnokit.plans.screening import kept_rows, screen_outliers, with_normalised_rate
from limnokit.plans.speciation import convert_ammonium
from limnokit.plans.workflows import rates_to_fits
from limnokit.session import COMPILED_BYTES, METHOD_LIMIT, compiled_steps, settle
from limnokit.sources.schemas import table_schema
from limnokit.sources.tables import read_bucketed, read_table, write_bucketed

SF = "/root/testdata/sf0.001"
KEYS = ["l_returnflag", "l_linestatus"]

needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables are absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange \w+", plan(df)))


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@needs_tables
def test_linear_fit_is_one_partial_aggregate_over_a_pruned_scan(lineitem):
    df = linear_fit(lineitem, KEYS, "l_quantity", "l_extendedprice", p_values=False)
    text = plan(df)
    assert shuffles(df) == 1 and text.count("partial_regr_sxy") >= 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_quantity", "l_extendedprice", *KEYS}


@needs_tables
def test_group_statistics_return_to_rows_without_moving_them(lineitem):
    df = attach_mean_sd(lineitem, KEYS, "l_quantity")
    assert shuffles(df) == 0 and "BroadcastHashJoin" in plan(df)


@needs_tables
def test_large_group_tables_are_shuffled_not_broadcast(spark, lineitem):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        df = attach_mean_sd(lineitem, ["l_orderkey"], "l_quantity")
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
        assert df.count() == lineitem.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@needs_tables
def test_fit_rounds_move_sums_only(lineitem):
    """Grids do not multiply rows, the compact rows stay where they are, and no task gets all sums."""
    compact = compact_doses(lineitem, KEYS, "l_quantity", "l_extendedprice")
    assert shuffles(compact) == 1
    df = saturation_fit(lineitem, KEYS, "l_quantity", "l_extendedprice", p_values=False)
    text = plan(df)
    assert shuffles(df) == 0 and "SortMergeJoin" not in text and "SinglePartition" not in text
    params = settle(lineitem.select(*KEYS).distinct().selectExpr("*", "1.0D AS km", "0.1D AS km_lo", "9.0D AS km_hi"), "params")
    grid = _grid_round(settle(compact, "doses"), params, KEYS, [2.0**i for i in range(49)])
    assert "Generate" not in plan(grid) and "Expand" not in plan(grid) and shuffles(grid) == 1


@needs_tables
def test_skipping_the_head_leaves_the_scan_where_it_is(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    df = skip_head(orders, ["o_orderstatus", "o_orderkey"], 70)
    assert shuffles(df) == 0 and "Sort" not in plan(df) and "Window" not in plan(df)
    assert df.count() == orders.count() - 70


@needs_tables
def test_quantiles_read_the_rows_twice(lineitem):
    """A sketch and a count; what is left reads settled tables."""
    text = plan(box_stats(lineitem, KEYS, "l_quantity"))
    assert text.count("lineitem.parquet") == 1 and "rank-ends" in text
    wide = plan(profile(lineitem, ["l_quantity", "l_tax", "l_discount"], quartiles=True))
    assert "lineitem.parquet" not in wide


def test_bucketed_tables_group_without_an_exchange(spark, tmp_path):
    keys = ["site", "inc_month", "type", "analyte"]
    row = dict.fromkeys(f.name for f in table_schema("uptake_rates")) | {"inc_month": "May", "type": "sediment", "analyte": "NO3"}
    data = [tuple({**row, "site": f"S{i % 9}", "mean_spike_conc": float(i % 5), "net_delta_conc_hr": float(i)}.values()) for i in range(200)]
    rates = spark.createDataFrame(data, table_schema("uptake_rates"))
    write_bucketed(rates, str(tmp_path / "rates"), keys, 4)
    back = read_bucketed(spark, str(tmp_path / "rates"), "uptake_rates", keys, 4)
    assert sorted(back.collect(), key=str) == sorted(rates.collect(), key=str)
    doses = compact_doses(back, keys, "mean_spike_conc", "net_delta_conc_hr")
    assert shuffles(doses) == 0 and shuffles(compact_doses(rates, keys, "mean_spike_conc", "net_delta_conc_hr")) == 1
    assert doses.count() == 45


def stored(spark, tmp_path, table, *values):
    path = str(tmp_path / table)
    spark.createDataFrame(list(values), table_schema(table)).write.parquet(path)
    return read_table(spark, path, table)


def test_rate_plan_never_shuffles_the_readings(spark, tmp_path):
    row = (dt.date(2023, 5, 1), "May", "GB3m", "GB", 1, "sediment", "NO3", 3.0, 0.0, None, None, None, None, 0.05,
           "6:30", 0.1, 2.0, 0.5, 1.0)
    raw = stored(spark, tmp_path, "incubation_raw", row)
    lake = stored(spark, tmp_path, "lake_ph_temp", ("E", "May", 15.0, 8.0))
    out = uptake_rates(convert_ammonium(raw, lake))
    text = plan(out)
    assert shuffles(out) == 0 and text.count("BroadcastHashJoin") == 3
    # The final substrate filter reaches the scan
    assert "In(type, [biofilm,sediment])" in text
    kept = kept_rows(screen_outliers(with_normalised_rate(settle(out, "rates"))))
    assert shuffles(kept) == 0 and "Join" not in plan(kept)


READING = (dt.date(2023, 5, 1), "May", "GB3m", "GB", 1, "sediment", "NO3", 3.0, 0.0, None, None, None, None, 0.05,
           "6:30", 0.1, 2.0, 0.5, 1.0)


def test_rates_of_readings_compute_each_step_once(spark, tmp_path):
    """The lake's share is a column of the lake table; screening is one test above the joins, not parts at the scan."""
    raw = stored(spark, tmp_path, "incubation_raw", READING)
    out = uptake_rates(convert_ammonium(raw, stored(spark, tmp_path, "lake_ph_temp", ("E", "May", 15.0, 8.0))))
    text = plan(kept_rows(screen_outliers(with_normalised_rate(out))))
    assert "POWER" not in text and "RLIKE" not in text
    assert 0 < text.index("BW10m") <= text.rindex("BW10m") < text.index("BroadcastHashJoin")


def test_steps_over_readings_are_compiled_in_any_session(spark, tmp_path, monkeypatch):
    """A method above HotSpot's limit runs interpreted: the steps that read the readings split it, the session keeps its own limit."""
    seen = {}

    def spy(df, label):
        seen[label] = int(spark.conf.get(METHOD_LIMIT))
        return settle(df, label)

    monkeypatch.setattr(rate_plans, "settle", spy)
    monkeypatch.setattr(doses, "settle", spy)
    own = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, "65535")
    try:
        raw = stored(spark, tmp_path, "incubation_raw", READING)
        rates_to_fits(uptake_rates(convert_ammonium(raw, stored(spark, tmp_path, "lake_ph_temp", ("E", "May", 15.0, 8.0)))))
        assert seen["control-sums"] == seen["doses"] == COMPILED_BYTES
        assert spark.conf.get(METHOD_LIMIT) == "65535"
        with pytest.raises(ValueError), compiled_steps(spark):
            raise ValueError
        assert spark.conf.get(METHOD_LIMIT) == "65535"
    finally:
        spark.conf.set(METHOD_LIMIT, own)


def test_gauge_and_period_filters_reach_the_scan(spark, tmp_path):
    daily = stored(spark, tmp_path, "discharge_daily", ("10336730", dt.date(2023, 1, 1), 1.0))
    text = plan(discharge_series(daily))
    assert "GreaterThanOrEqual(date,2023-01-01)" in text and "LessThanOrEqual(date,2023-09-01)" in text
    assert text.count("FileScan") == 1 and "Union" not in text
