import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from limnokit.operators import groups, histogram, joins, order_stats, ordered
from limnokit.operators.loess import loess_curve
from limnokit.operators.profile import head, profile
from limnokit.operators.reshape import to_long
from limnokit.session import settle


def test_null_safe_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k2 string, w int")
    got = rows(joins.null_safe_join(left, right, [("k", "k2")]))
    assert got == rows(spark.createDataFrame([("a", 1, 10), (None, 2, 20), ("z", 3, None)], "k string, v int, w int"))
    with pytest.raises(ValueError):
        joins.null_safe_join(left, right.withColumnRenamed("w", "v"), [("k", "k2")])


def test_join_of_a_table_with_its_own_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("b", 9.0)], "k string, v double")
    got = {(r.k, r.v): (r.mean, r.sd) for r in groups.attach_mean_sd(df, ["k"], "v").collect()}
    assert got[("a", 1.0)] == pytest.approx((2.0, 2**0.5))
    assert got[(None, 7.0)] == pytest.approx((6.0, 2**0.5))
    assert got[("b", 9.0)] == (9.0, None)


def test_deny_list_without_a_match_drops_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert joins.drop_listed(df, ["x"], "k").count() == 2
    assert rows(joins.drop_listed(df, ["a"], "k")) == [(None,)]
    listed = spark.createDataFrame([("a",)], "other string")
    assert rows(joins.drop_listed(df, listed, "k")) == [(None,)]
    assert rows(joins.keep_listed(df, listed, "k")) == [("a",)]


def test_recode_from_table(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    table = spark.createDataFrame([("a", "A")], "from string, to string")
    kept = joins.recode_from_table(df, "k", table, "out")
    assert rows(kept) == [("a", "A"), ("z", "z"), (None, None)]
    strict = joins.recode_from_table(df, "k", table, "out", keep_unmatched=False)
    assert rows(strict) == [("a", "A"), ("z", None), (None, None)]


def test_conditional_counts_treat_missing_as_no(spark):
    df = spark.createDataFrame([("g", 0.01), ("g", None), ("g", 0.5), ("h", None)], "k string, p double")
    shares = groups.conditional_shares(df, ["k"], {"n_sig": F.col("p") < 0.05}, "n_sig", "share")
    assert rows(shares) == [("g", 3, 1, pytest.approx(1 / 3)), ("h", 1, 0, 0.0)]


def test_roll_up_is_a_ratio_of_sums(spark):
    counts = spark.createDataFrame([("s", "a", 1, 2), ("s", "b", 1, 8)], "k string, z string, part int, total int")
    assert rows(groups.roll_up_share(counts, ["k"], "part", "total", "p", "t", "share")) == [("s", 10, 2, 0.2)]


def test_box_stats(spark):
    random.seed(2)
    groups_ = {
        "a": [random.lognormvariate(0, 2) for _ in range(501)],
        "b": [1.0] * 40,
        "c": [1.0, 2.0],
        "d": [float(v) for v in [1, 2, 3, 4, 100]],
        "e": [5.0],
        None: [random.gauss(0, 1) * 10 ** random.randint(-8, 8) for _ in range(1000)],
    }
    data = [(g, v) for g, vs in groups_.items() for v in vs] + [("a", None), ("f", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r.g: r for r in order_stats.box_stats(df, ["g"], "v").collect()}
    assert set(got) == set(groups_)
    for g, values in groups_.items():
        q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        reach = 1.5 * (q3 - q1)
        inside = [v for v in values if q1 - reach <= v <= q3 + reach]
        want = (len(values), q1, med, q3, min([*inside, q1]), max([*inside, q3]), len(values) - len(inside))
        r = got[g]
        assert (r.n, r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.n_outliers) == pytest.approx(want, rel=1e-12)
    out = order_stats.box_outliers(df, ["g"], "v").filter("g = 'd'")
    assert rows(out) == [("d", 100.0)]


def test_ranks_over_the_whole_range_of_doubles(spark):
    """Infinities, NaN, both ends of the range, zeros, subnormals and neighbours, within the bound of rounds."""
    random.seed(7)
    values = [math.inf, -math.inf, math.nan, 1.7976931348623157e308, -1.7976931348623157e308, 0.0, 5e-324, -5e-324, 1.0]
    values += [math.nextafter(1.0, 2.0), math.nextafter(1.0, 0.0)] * 2
    values += [random.choice([-1, 1]) * 10.0 ** random.uniform(-320, 308) for _ in range(300)]
    values += [1 + i * 2.0**-52 for i in range(200)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(3)
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    targets = spark.createDataFrame([("g", str(k), k) for k in range(1, len(values) + 1)], "g string, target string, rank bigint")
    got = {r["rank"]: r["value"] for r in order_stats.select_ranks(df, ["g"], "v", targets).collect()}
    assert len(got) == len(values)
    for k, want in enumerate(order, 1):
        assert got[k] == want or (math.isnan(got[k]) and math.isnan(want))


def test_histogram_counts_finite_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.5, math.inf, -math.inf, math.nan, None)], "v double")
    assert sum(r["n"] for r in histogram.histogram(df, "v", 3).collect()) == 3


def test_select_ranks_with_weights(spark):
    df = spark.createDataFrame([("g", 1.0, 3), ("g", 2.0, 1), ("g", 5.0, 2)], "g string, v double, n int")
    targets = spark.createDataFrame([("g", str(k), k) for k in range(1, 7)], "g string, target string, rank bigint")
    got = order_stats.select_ranks(df, ["g"], "v", targets, weight="n")
    assert [r.value for r in got.orderBy("rank").collect()] == [1, 1, 1, 2, 5, 5]


def test_approximate_quantiles(spark):
    df = spark.range(1, 1002).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    r = order_stats.approximate_quantiles(df, ["g"], "v", {"median": 0.5}).first()
    assert r.n == 1001 and abs(r.median - 501) <= 1


@pytest.mark.parametrize(
    "low,high,cells,want",
    [
        (0.0, 10.0, 5, [0, 2, 4, 6, 8, 10]),
        (1.0, 9.7, 6, [0, 2, 4, 6, 8, 10]),
        (0.0, 1.0, 8, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]),
        (-3.2, 4.1, 4, [-4, -2, 0, 2, 4, 6]),
        (105.0, 995.0, 10, [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]),
    ],
)
def test_round_breaks(low, high, cells, want):
    assert histogram.round_breaks(low, high, cells) == pytest.approx(want)


def test_histogram_is_right_closed_and_lists_empty_cells(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 2.0, 2.1, 8.5, 10.0, None]], "v double")
    got = [(r.lower, r.upper, r.n) for r in histogram.histogram(df, "v", 5).orderBy("cell").collect()]
    assert got == [(0, 2, 2), (2, 4, 1), (4, 6, 0), (6, 8, 0), (8, 10, 2)]
    empty = histogram.histogram(df.filter("v is null"), "v")
    assert empty.count() == 0
    single = histogram.histogram(df.filter("v = 2.0"), "v")
    assert single.agg(F.sum("n")).first()[0] == 1


def test_row_positions_over_many_partitions(spark):
    data = [(i % 7, i) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b int").withColumn("a", F.nullif("a", F.lit(3))).repartition(9)
    order = [F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last()]
    want = sorted(((None if a == 3 else a), b) for a, b in data if a != 3)
    want += [(None, b) for a, b in data if a == 3]
    got = ordered.with_row_position(df, order).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 501))
    assert [(r.a, r.b) for r in got] == want
    assert rows(ordered.skip_head(df, ["a", "b"], 490).select("b")) == rows(spark.createDataFrame([(b,) for _, b in want[490:]], "b int"))
    assert [r.a for r in ordered.sort_rows(df, "a", "b").collect()][-1] is None


def test_skipped_rows_fill_the_count_among_ties(spark):
    data = [(a, b, i) for i, (a, b) in enumerate([(1, "x"), (1, "x"), (1, None), (2, "x"), (2, "x"), (2, "x"), (None, "y"), (None, None), (None, None)] * 3)]
    df = spark.createDataFrame(data, "a int, b string, i int").repartition(5)
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    for count in (0, 1, 4, 7, 8, 13, 20, 26, 27, 40):
        for top in (1000, 3):
            left = ordered.skip_head(df, ["a", "b"], count, top).collect()
            assert sorted(map(str, [r[:2] for r in left])) == sorted(str(r[:2]) for r in order[count:])
            assert len({r.i for r in left}) == len(left)


def test_a_group_that_is_the_table_is_cut_into_segments(spark):
    random.seed(6)
    values = [None if i == 700 else float(i % 13) for i in range(1000)]
    df = spark.createDataFrame([("hot" if i % 50 else "rare", i, v) for i, v in enumerate(values)], "k string, i int, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = ordered.in_segments(df, ["k"], ["i"])
        assert cut.filter("k = 'hot'").select(ordered.SEGMENT).distinct().count() >= 3
        out = ordered.with_running_sum(ordered.with_previous(df, ["k"], ["i"], "v", "p", default=-1.0), ["k"], ["i"], "v", "t")
        out = settle(out, "scans")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == ["k", "i", "v", "p", "t"]
    for k in ("hot", "rare"):
        before, run = -1.0, 0.0
        for r in out.filter(F.col("k") == k).orderBy("i").collect():
            run = None if run is None or r.v is None else run + r.v
            assert (r.p, r.t) == (before, run)
            before = r.v


def test_quantiles_with_ties_odd_values_and_any_size(spark):
    random.seed(3)
    groups = {f"n{n}": [random.choice([random.gauss(0, 1), 0.5, 2.0]) for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 18, 100, 3000)}
    groups |= {"same": [4.0] * 50, "inf": [float("inf"), float("-inf"), 1.0, 2.0] * 9, "nan": [float("nan"), 1.0, 2.0, 3.0, 4.0], "large": [float(i * i % 99991) for i in range(60_000)]}
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("null", None), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in order_stats.group_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups) | {None} and got[None].c == 3.0
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (v != v, v))
        for name, p in probs.items():
            at = (len(vs) - 1) * p
            low, high = vs[math.floor(at)], vs[min(math.floor(at) + 1, len(vs) - 1)]
            want = low if at == math.floor(at) or low == high else low * (1 - at % 1) + high * (at % 1)
            assert got[g][name] == pytest.approx(want, nan_ok=True), (g, name)


def test_running_min_across_segments(spark):
    rng = random.Random(6)
    data = [(k, i, rng.choice([None, rng.random()])) for k in ("a", None) for i in range(80)]
    got = ordered.with_running_min(spark.createDataFrame(data, "k string, i int, v double").repartition(5), ["k"], ["i"], "v", "m").collect()
    for r in got:
        met = [v for k, i, v in data if k == r.k and i <= r.i and v is not None]
        assert r.m == (min(met) if met else None)


def test_previous_and_running_sum_cross_slices(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    random.seed(4)
    series = {"a": [random.random() for _ in days], "b": [random.random() for _ in days]}
    series["b"][60] = None
    data = [(s, d, v) for s, vs in series.items() for d, v in zip(days, vs)]
    df = spark.createDataFrame(data, "s string, d date, v double").repartition(5)
    df = df.withColumn("m", F.trunc("d", "month"))
    prev = ordered.with_previous(df, ["s"], ["d"], "v", "p", "m", default=0.0)
    got = {(r.s, r.d): r.p for r in prev.collect()}
    total = ordered.with_running_sum(df, ["s"], ["d"], "v", "t", "m")
    sums = {(r.s, r.d): r.t for r in total.collect()}
    for s, vs in series.items():
        run = 0.0
        for i, d in enumerate(days):
            assert got[(s, d)] == (0.0 if i == 0 else vs[i - 1])
            run = None if run is None or vs[i] is None else run + vs[i]
            assert sums[(s, d)] == (None if run is None else pytest.approx(run))


def test_profile_and_reshape(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5), (4.0, 6)], "a double, b int")
    got = {r.column: r for r in profile(df, ["a", "b"], quartiles=True).collect()}
    assert (got["a"].n_rows, got["a"].n_missing, got["a"].min, got["a"].max) == (3, 0, 1.0, 4.0)
    assert (got["b"].n_missing, got["b"].mean, got["b"].median) == (1, 5.5, 5.5)
    assert rows(to_long(df.withColumn("b", F.col("b").cast("double")), [], ["a", "b"], "k", "v"))[-1] == ("b", None)
    assert head(df, 2).count() == 2


def brute_loess(x, y, at, span=0.75):
    q = int(np.floor(len(x) * span + 1e-5))
    d = np.abs(x - at)
    h = np.sort(d)[q - 1]
    w = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
    design = np.vander(x - at, 3, increasing=True)
    sw = np.sqrt(w)
    return np.linalg.lstsq(design * sw[:, None], y * sw, rcond=None)[0][0]


def test_loess_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(1, 13, 120).astype(float)
    y = np.sin(x / 3) + 0.1 * rng.standard_normal(120)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = loess_curve(df, ["g"], "x", "y", points=9).orderBy("point").collect()
    assert len(got) == 9
    for r in got:
        assert r.y == pytest.approx(brute_loess(x, y, r.x), rel=1e-8)


def test_loess_of_many_distinct_x(spark, monkeypatch):
    monkeypatch.setattr("limnokit.operators.loess.BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.exponential(2, 300), np.full(60, 0.5)])  # crowded at one end, one value met often
    y = np.cos(x) + 0.1 * rng.standard_normal(len(x))
    data = [(g, float(a), float(b)) for g, m in (("a", 360), (None, 45)) for a, b in zip(x[:m], y[:m])]
    got = loess_curve(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y", points=30).collect()
    assert len(got) == 60
    for r in got:
        m = 360 if r.g == "a" else 45
        assert r.y == pytest.approx(brute_loess(x[:m], y[:m], r.x), rel=1e-6, abs=1e-9)


def test_loess_falls_back_with_few_distinct_x(spark):
    data = [("two", 1.0, 1.0), ("two", 1.0, 3.0), ("two", 2.0, 4.0), ("two", 2.0, 4.0), ("one", 5.0, 1.0), ("one", 5.0, 2.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = loess_curve(df, ["g"], "x", "y", points=3).collect()
    assert {r.y for r in got if r.g == "one"} == {1.5}
    assert all(1.0 <= r.y <= 4.0 for r in got if r.g == "two")
