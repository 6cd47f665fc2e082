import datetime as dt
import math

import pytest

from limnokit.functions import clock, numeric, text
from limnokit.functions.tdist import two_sided_p


def one(spark, ddl, values, expr):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], ddl)
    return [r[0] for r in df.select(expr.alias("out")).collect()]


def test_prefix_and_substring_treat_missing_as_no(spark):
    values = ["GB1", "SHx", "xGB", "", None]
    assert one(spark, "s string", values, text.starts_with_any("s", ["GB", "SH"])) == [True, True, False, False, False]
    assert one(spark, "s string", values, text.contains_text("s", "GB")) == [True, False, True, False, False]


def test_letters_keys_and_paste(spark):
    assert one(spark, "s string", ["BW0.5m", "7up", None], text.leading_letters("s")) == ["BW", None, None]
    assert one(spark, "s string", ["a_b", "a", None], text.key_part("s", 1)) == ["b", None, None]
    assert one(spark, "a string, b string", [("x", "y"), (None, "y")], text.paste("a", "b", sep="_")) == ["x_y", "NA_y"]
    assert one(spark, "s string", ["a_b_c"], text.without_text("s", "_")) == ["abc"]


def test_clock_readings(spark):
    values = ["6:46", "06:46", " 7:05", "6:46:30", "25:10", "6:75", "n/a", "", None]
    expected = ["06:46:00", "06:46:00", "07:05:00", "06:46:00", None, "06:7:00", None, None, None]
    got = one(spark, "s string", values, clock.normal_clock("s"))
    expected[5] = "06:07:00"
    assert got == expected
    assert one(spark, "s string", ["6:30", "x:30", "6", None], clock.split_hours("s")) == [6.5, None, None, None]


def test_incubation_hours_default_and_cap(spark):
    df = spark.createDataFrame([("6:30",), ("7:41",), ("7:42",), ("bad",), (None,)], "s string")
    got = [r.h for r in clock.with_incubation_hours(df, "s", "h").collect()]
    fill = 6 + 46 / 60
    assert got == [6.5, 7 + 41 / 60, fill, fill, fill]


def test_two_digit_years_and_bad_dates(spark):
    values = ["5/24/23", "05/24/68", "1/2/69", "12/31/99", "13/1/23", "2/30/23", "x", None]
    expected = [
        dt.date(2023, 5, 24), dt.date(2068, 5, 24), dt.date(1969, 1, 2), dt.date(1999, 12, 31), None, None, None, None,
    ]
    assert one(spark, "s string", values, clock.short_date("s")) == expected


def test_ratio_and_membership(spark):
    assert one(spark, "a double, b double", [(1.0, 0.0), (1.0, 2.0), (None, 1.0)], numeric.ratio("a", "b")) == [None, 0.5, None]
    values = ["a", "b", None]
    assert one(spark, "s string", values, numeric.not_in("s", ["a"])) == [False, True, True]
    assert one(spark, "s string", values, numeric.is_in("s", ["a"])) == [True, False, False]
    pairs = [(1.0, None), (2.0, 1.0), (None, None)]
    assert one(spark, "a double, b double", pairs, numeric.row_min("a", "b")) == [1.0, 1.0, None]


def test_recode_and_rank(spark):
    values = ["a", "z", None]
    assert one(spark, "s string", values, numeric.recode("s", {"a": "A"})) == ["A", "z", None]
    assert one(spark, "s string", values, numeric.recode("s", {"a": "A"}, keep_unmatched=False)) == ["A", None, None]
    assert one(spark, "s string", values, numeric.label_rank("s", ["b", "a"])) == [2, None, None]


def exact_p(t, df):
    """Closed form of the two-sided tail for whole df (finite trigonometric series)."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(3, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        return 1 - 2 / math.pi * (theta + s * total)
    total, term = 0.0, 1.0
    for k in range(2, df + 1, 2):
        total += term
        term *= c * c * (k - 1) / k
    return 1 - s * total


@pytest.mark.parametrize("df", [1, 2, 5, 16, 60, 401])
def test_p_values_match_the_finite_series(spark, df):
    ts = [0.0, 1e-3, 0.5, 1.0, 2.0, 3.5, -2.2]
    got = one(spark, "t double, df int", [(t, df) for t in ts], two_sided_p("t", "df"))
    for t, p in zip(ts, got):
        assert p == pytest.approx(exact_p(t, df), rel=1e-9, abs=1e-13)


def test_p_values_small_tails_large_df_and_missing(spark):
    cases = [(40.0, 10), (2.0, 100_000), (2.0, 100_001), (2.0, 10**12), (None, 5), (1.0, 0), (50.0, 10**9)]
    got = one(spark, "t double, df bigint", cases, two_sided_p("t", "df"))
    # P(|T10| > 40): leading terms of the tail series give 2.4e-12
    assert got[0] == pytest.approx(2.36e-12, rel=0.05)
    assert got[1] == pytest.approx(got[2], rel=1e-7)
    assert got[3] == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-9)
    assert got[4] is None and got[5] is None
    assert 0.0 <= got[6] < 1e-300


# Estimate, standard error, df and p of published fits
PUBLISHED = [
    (0.000146586465292335, 2.5763299993407e-05, 16, 3.35090085530855e-05),
    (0.00956325785573653, 0.00348563311107167, 16, 0.0144218990496525),
    (0.0949132279994631, 0.0059049295144728, 16, 2.69815006245261e-11),
    (0.116611459545622, 0.00671981375099216, 16, 8.43376250544086e-12),
    (702.805875256276, 335.016105394793, 16, 0.0521565310440178),
    (103.112809205114, 53.142241570162, 16, 0.0701740476185928),
]


def test_p_values_match_published_fits(spark):
    cases = [(est / se, df) for est, se, df, _ in PUBLISHED]
    got = one(spark, "t double, df int", cases, two_sided_p("t", "df"))
    for p, (_, _, _, want) in zip(got, PUBLISHED):
        assert p == pytest.approx(want, rel=1e-10, abs=1e-15)
