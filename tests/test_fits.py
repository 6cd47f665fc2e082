import math

import numpy as np
import pytest

from limnokit.operators.doses import settled_doses
from limnokit.operators.linear_fit import linear_fit, linear_fit_of_doses
from limnokit.operators.predict import predict_grid, saturation_at, trend_line
from limnokit.operators.saturation_fit import saturation_fit, saturation_fit_of_doses

DOSES = [0.0, 50.0, 100.0, 200.0, 400.0, 800.0]


def mm_rows(group, vmax, km, noise, seed=1, copies=3):
    rng = np.random.default_rng(seed)
    return [
        (group, x, float(vmax * x / (km + x) + noise * rng.standard_normal())) for x in DOSES for _ in range(copies)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "g string, x double, y double")


def reference_mm(points):
    """Dense one-dimensional search for the same optimum, with the observed-Hessian errors."""
    x = np.array([p[1] for p in points])
    y = np.array([p[2] for p in points])

    def sse(km):
        u = x / (km + x)
        v = (u @ y) / (u @ u)
        return ((y - v * u) ** 2).sum(), v

    grid = np.exp(np.linspace(math.log(1e-3), math.log(1e6), 20001))
    best = grid[np.argmin([sse(k)[0] for k in grid])]
    lo, hi = best * 0.99, best * 1.01
    for _ in range(200):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if sse(a)[0] < sse(b)[0] else (a, hi)
    km = (lo + hi) / 2
    rss, v = sse(km)
    u, u1, u2 = x / (km + x), -x / (km + x) ** 2, 2 * x / (km + x) ** 3
    e = y - v * u
    h = 2 * np.array([
        [(u * u).sum(), (v * u * u1 - e * u1).sum()],
        [(v * u * u1 - e * u1).sum(), (v * v * u1 * u1 - e * v * u2).sum()],
    ])
    cov = 2 * rss / (len(x) - 2) * np.linalg.inv(h)
    return v, km, math.sqrt(cov[0, 0]), math.sqrt(cov[1, 1]), rss


def test_saturation_fit_matches_a_dense_search(spark):
    groups = {
        "a": mm_rows("a", 30, 100, 1.0, 1),
        "b": mm_rows("b", 5, 700, 0.2, 2),
        "c": mm_rows("c", -8, 150, 0.3, 3),
        "d": mm_rows("d", 1e4, 20, 150.0, 4),
    }
    df = frame(spark, sum(groups.values(), []))
    fits = {r.g: r for r in saturation_fit(df, ["g"], "x", "y").collect()}
    for g, points in groups.items():
        v, km, se_v, se_km, rss = reference_mm(points)
        r = fits[g]
        assert r.status == "ok" and r.n == 18 and r.df_resid == 16 and r.n_doses == 5
        assert r.vmax == pytest.approx(v, rel=1e-6)
        assert r.km == pytest.approx(km, rel=1e-5)
        assert r.se_vmax == pytest.approx(se_v, rel=1e-4)
        assert r.se_km == pytest.approx(se_km, rel=1e-4)
        assert r.rss == pytest.approx(rss, rel=1e-9)
        assert r.ci_low_km == pytest.approx(r.km - 1.96 * r.se_km)
        assert r.ci_high_vmax == pytest.approx(r.vmax + 1.96 * r.se_vmax)
        assert 0 <= r.p_km <= 1


def test_saturation_fit_failure_policy(spark):
    data = (
        mm_rows("good", 10, 100, 0.1)
        + [("line", x, 2.0 * x) for x in DOSES]
        + [("two", 100.0, 3.0), ("two", 200.0, 5.0)]
        + [("one_dose", 100.0, 3.0), ("one_dose", 100.0, 4.0), ("one_dose", 0.0, 0.1)]
        + [("zero_x", 0.0, 1.0), ("zero_x", 0.0, 2.0)]
        + [("null_y", 10.0, None), ("null_y", 20.0, None)]
        + [("negative", -5.0, 1.0), ("negative", None, 1.0)]
        + [("flat", x, 7.0) for x in DOSES if x > 0]
        + [(None, x, 10 * x / (100 + x) + (0.1 if x > 100 else -0.1)) for x in DOSES]
    )
    df = frame(spark, data)
    got = {r.g: r for r in saturation_fit(df, ["g"], "x", "y", keep_failed=True).collect()}
    status = {g: r.status for g, r in got.items()}
    assert status == {
        "good": "ok", "line": "at_bound", "two": "singular", "one_dose": "singular", "zero_x": "failed",
        "null_y": "failed", "negative": "failed", "flat": "at_bound", None: "ok",
    }
    assert got["two"].vmax is not None and got["two"].se_km is None and got["two"].p_km is None
    assert got["negative"].n == 0 and got["negative"].n_excluded == 2
    assert got["null_y"].vmax is None
    kept = {r.g for r in saturation_fit(df, ["g"], "x", "y").collect()}
    assert kept == {g for g, s in status.items() if s != "failed"}


def test_saturation_fit_takes_continuous_doses(spark):
    rng = np.random.default_rng(5)
    xs = rng.uniform(1, 900, 400)
    data = [("wide", float(x), float(20 * x / (150 + x) + 0.5 * rng.standard_normal())) for x in xs]
    points = mm_rows("narrow", 30, 100, 1.0)
    fits = {r.g: r for r in saturation_fit(frame(spark, data + points), ["g"], "x", "y").collect()}
    for g, pts in (("wide", data), ("narrow", points)):
        v, km, se_v, se_km, _ = reference_mm(pts)
        assert fits[g].vmax == pytest.approx(v, rel=1e-6)
        assert fits[g].km == pytest.approx(km, rel=1e-5)
        assert fits[g].se_km == pytest.approx(se_km, rel=1e-4)


def test_both_fits_start_from_one_table_of_doses(spark):
    """Line and curve of the compact table are those of the readings; a negative dose is the line's only."""
    rng = np.random.default_rng(9)
    data = mm_rows("a", 30, 100, 1.0) + [("a", -20.0, 1.0), ("a", -20.0, 4.0), ("a", None, 3.0), ("a", 50.0, None)]
    data += [("far", 1e6 + float(x), float(1e6 + 2 * x + y)) for x, y in zip(rng.uniform(0, 9, 60), rng.standard_normal(60))]
    data += [("one", 5.0, 1.0), ("none", None, 1.0), ("none", 3.0, None)]
    df = frame(spark, data)
    doses = settled_doses(df, ["g"], "x", "y")
    want = {r.g: r for r in linear_fit(df, ["g"], "x", "y", keep_failed=True).collect()}
    got = {r.g: r for r in linear_fit_of_doses(doses, ["g"], keep_failed=True).collect()}
    assert set(got) == set(want) == {"a", "far", "one", "none"}
    for g in want:
        assert (got[g].status, got[g].n, got[g].df_resid) == (want[g].status, want[g].n, want[g].df_resid)
    for g in ("a", "far"):
        for c in ("slope", "intercept", "se_slope", "se_intercept", "p_slope", "x_min", "x_max"):
            assert got[g][c] == pytest.approx(want[g][c], rel=1e-7), (g, c)
    curve, alone = (f.filter("g = 'a'").first() for f in (saturation_fit_of_doses(doses, ["g"]), saturation_fit(df, ["g"], "x", "y")))
    assert curve == alone and curve.n == 18 and curve.n_excluded == 4


def test_every_group_settles(spark):
    """Noisy, steep and flat groups: Newton goes on until each stands still or lies at an end of the range."""
    rng = np.random.default_rng(12)
    data = [(f"g{k}", x, float(5 * x / (10 ** (k % 7) + x) + rng.standard_normal())) for k in range(60) for x in DOSES[1:] * 2]
    got = saturation_fit(frame(spark, data), ["g"], "x", "y").collect()
    assert len(got) == 60 and {r.status for r in got} <= {"ok", "at_bound", "singular"}


def test_saturation_fit_does_not_depend_on_partitioning(spark):
    data = mm_rows("a", 30, 100, 1.0, copies=30) + mm_rows("b", 5, 700, 0.2, 2, copies=30)
    results = []
    for parts in (1, 64):
        df = frame(spark, data).repartition(parts)
        results.append({r.g: (r.vmax, r.km, r.se_km) for r in saturation_fit(df, ["g"], "x", "y").collect()})
    for g in ("a", "b"):
        assert results[0][g] == pytest.approx(results[1][g], rel=1e-9)


def test_gauss_newton_covariance_is_close_but_not_equal(spark):
    df = frame(spark, mm_rows("a", 30, 100, 2.0))
    observed = saturation_fit(df, ["g"], "x", "y").first()
    plain = saturation_fit(df, ["g"], "x", "y", covariance="gauss_newton").first()
    assert plain.km == observed.km and plain.se_km != observed.se_km
    assert plain.se_km == pytest.approx(observed.se_km, rel=0.2)
    with pytest.raises(ValueError):
        saturation_fit(df, ["g"], "x", "y", covariance="other")


def test_linear_fit_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 40)
    y = 1e6 + 2 * x + rng.standard_normal(40)
    df = frame(spark, [("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("a", 3.0, None)])
    r = linear_fit(df, ["g"], "x", "y").first()
    design = np.column_stack([np.ones(40), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    cov = rss[0] / 38 * np.linalg.inv(design.T @ design)
    assert (r.n, r.df_resid, r.status) == (40, 38, "ok")
    assert r.intercept == pytest.approx(beta[0], rel=1e-12)
    assert r.slope == pytest.approx(beta[1], rel=1e-8)
    assert r.se_intercept == pytest.approx(math.sqrt(cov[0, 0]), rel=1e-7)
    assert r.se_slope == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-7)


def test_linear_fit_degenerate_groups(spark):
    data = [("two", 1.0, 1.0), ("two", 2.0, 3.0), ("flat_x", 1.0, 1.0), ("flat_x", 1.0, 2.0), ("one", 1.0, 1.0),
            ("exact", 1.0, 2.0), ("exact", 2.0, 4.0), ("exact", 3.0, 6.0), ("none", None, 1.0)]
    got = {r.g: r for r in linear_fit(frame(spark, data), ["g"], "x", "y", keep_failed=True).collect()}
    assert {g: r.status for g, r in got.items()} == {
        "two": "exact", "flat_x": "failed", "one": "failed", "exact": "exact", "none": "failed",
    }
    assert got["two"].slope == 2.0 and got["two"].se_slope is None and got["two"].p_slope is None
    assert {r.g for r in linear_fit(frame(spark, data), ["g"], "x", "y").collect()} == {"two", "exact"}


def test_prediction_grids(spark):
    fits = spark.createDataFrame([("a", 10.0, 100.0, 800.0)], "g string, vmax double, km double, x_max double")
    grid = predict_grid(fits, ["g"], saturation_at).orderBy("point").collect()
    assert len(grid) == 100 and grid[0].x == 0.0 and grid[0].y == 0.0
    assert grid[99].x == 800.0 and grid[99].y == pytest.approx(10 * 800 / 900)
    line = trend_line(frame(spark, [("a", 1.0, 3.0), ("a", 3.0, 7.0), (None, 0.0, 0.0), (None, 1.0, 1.0)]), ["g"], "x", "y", 3)
    assert [(r.x, r.y) for r in line.filter("g = 'a'").orderBy("point").collect()] == [(1, 3), (2, 5), (3, 7)]
    assert line.filter("g is null").count() == 3
