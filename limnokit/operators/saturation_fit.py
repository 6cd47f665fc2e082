"""Michaelis-Menten curves ``y = vmax * x / (km + x)`` for every group at once.

The readings are read once: equal doses of a group collapse to (count, mean,
spread) without loss, and every later step is a sum over that compact table.
For a fixed ``km`` the best ``vmax`` has a closed form, so only ``km`` is
searched: two grids of candidates, the second around the best of the first,
then Newton steps on ln(km) until no group moves.

There is one way for every number of groups and doses. A round is one grouped
aggregate over the compact rows: a grid has two sums a candidate, side by side
in the aggregate's row, so rows are not multiplied and a group of any size is a
reduce key whose rows are summed before anything is shuffled. Between rounds a
settled table keeps one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.operators.doses import compact_doses, settled_doses
from limnokit.operators.joins import null_safe_join
from limnokit.operators.linear_fit import with_p_values
from limnokit.session import settle

__all__ = ["compact_doses", "saturation_fit", "saturation_fit_of_doses"]

COARSE_STEPS = 48
FINE_STEPS = 24
# Newton goes on while any group's km moves by more than this share; the error left is about its square
STILL = 1e-6
NEWTON_ROUNDS = 40
# A search has converged if the last step changed km by no more than this share
SETTLED = 1e-5
BRACKET = ["km", "km_lo", "km_hi"]


def _pair(doses: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Each compact row with its group's parameters, a settled table whose size Catalyst knows."""
    return null_safe_join(doses, params, keys, "inner")


def _grid_round(doses: DataFrame, params: DataFrame, keys: list[str], ratios: list[float]) -> DataFrame:
    """The best of the candidates ``km * ratio``; the smaller one on a tie. The bracket becomes the ratio next to it."""
    # As SQL text: so many terms are slow to build one column operation at a time
    sums, tried = [], []
    for i, ratio in enumerate(ratios):
        u = f"(x / (km * {ratio!r}D + x))"
        sums += [F.expr(f"sum(n * y_mean * {u}) AS uy{i}"), F.expr(f"sum(n * {u} * {u}) AS uu{i}")]
        # Reduction of the squared residuals by the best vmax
        tried.append(f"named_struct('gain', try_divide(uy{i} * uy{i}, uu{i}), 'back', {-i}, 'km', km * {ratio!r}D)")
    scored = _pair(doses, params, keys).groupBy(*keys, *BRACKET).agg(*sums)
    step = ratios[1] / ratios[0]
    best = scored.withColumn("best", F.expr(f"array_max(array({', '.join(tried)})).km"))
    lo, hi = F.greatest("km_lo", F.col("best") / F.lit(step)), F.least("km_hi", F.col("best") * F.lit(step))
    return best.select(*keys, F.least(F.greatest("best", "km_lo"), "km_hi").alias("km"), lo.alias("km_lo"), hi.alias("km_hi"))


U, U1, U2 = "(x / (km + x))", "(-x / ((km + x) * (km + x)))", "(2 * x / ((km + x) * (km + x) * (km + x)))"


def _sums(terms: dict[str, str]) -> list[Column]:
    return [F.expr(f"sum({term}) AS {name}") for name, term in terms.items()]


def _newton_round(doses: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """One Newton step on ln(km) for the residuals at the best ``vmax``, kept in the bracket."""
    terms = {
        "uy": f"n * y_mean * {U}", "u1y": f"n * y_mean * {U1}", "u2y": f"n * y_mean * {U2}", "uu": f"n * {U} * {U}",
        "uu1": f"n * {U} * {U1}", "u1u1": f"n * {U1} * {U1}", "uu2": f"n * {U} * {U2}",
    }
    sums = _pair(doses, params.select(*keys, *BRACKET), keys).groupBy(*keys, *BRACKET).agg(*_sums(terms))
    carried = [*keys, *BRACKET]
    best = sums.selectExpr("*", "try_divide(uy, uu) AS __v").selectExpr("*", "u1y - __v * uu1 AS __e1", "u2y - __v * uu2 AS __e2")
    bent = best.selectExpr(
        *carried, "__v", "-2 * __v * __e1 AS __slope",
        "2 * (__v * __v * u1u1 - __v * __e2) - try_divide(pow(2 * (__v * uu1 - __e1), 2), 2 * uu) AS __bend",
    )
    logs = bent.selectExpr(*carried, "__v", "km * __slope AS __g", "km * km * __bend + km * __slope AS __h")
    step = logs.selectExpr(*carried, "__v", "CASE WHEN __h > 0 THEN greatest(least(-__g / __h, 1D), -1D) ELSE 0D END AS __step")
    moved = step.selectExpr(*carried, "__v", "greatest(least(km * exp(__step), km_hi), km_lo) AS __after")
    return moved.selectExpr(*keys, "__after AS km", "km_lo", "km_hi", "abs(__after / km - 1) AS moved", "__v AS near_vmax")


def _shape(doses: DataFrame, params: DataFrame, keys: list[str], covariance: str) -> DataFrame:
    """Best ``vmax`` at the found ``km``, the residual sum of squares and its Hessian in (vmax, km).

    All of them follow from residuals at a nearby ``vmax``, corrected exactly
    for the difference, so one pass does and nothing cancels.
    """
    r = f"(y_mean - near_vmax * {U})"
    terms = {
        "rr": f"spread + n * {r} * {r}", "ru": f"n * {r} * {U}", "ru1": f"n * {r} * {U1}", "ru2": f"n * {r} * {U2}",
        "uu": f"n * {U} * {U}", "uu1": f"n * {U} * {U1}", "u1u1": f"n * {U1} * {U1}", "uu2": f"n * {U} * {U2}",
    }
    group = [*keys, "km", "moved", "near_vmax"]
    sums = _pair(doses, params.select(*group), keys).groupBy(*group).agg(*_sums(terms))
    near = sums.selectExpr("*", "try_divide(ru, uu) AS __more").selectExpr("*", "near_vmax + __more AS vmax", "ru1 - __more * uu1 AS __e1", "ru2 - __more * uu2 AS __e2")
    observed = "1D" if covariance == "observed" else "0D"
    return near.selectExpr(
        *keys, "km", "moved", "vmax", "rr - __more * ru AS rss", "2 * uu AS h_vv",
        f"2 * (vmax * uu1 - {observed} * __e1) AS h_vk", f"2 * (vmax * vmax * u1u1 - {observed} * vmax * __e2) AS h_kk",
    )


def _facts(doses: DataFrame, keys: list[str]) -> DataFrame:
    """Readings used and not used, positive doses, and the largest doses of each group."""
    valid = F.col("x") >= 0
    used = F.when(valid, F.col("n"))
    return doses.groupBy(*keys).agg(
        F.coalesce(F.sum(used), F.lit(0)).alias("n"),
        (F.sum("rows") - F.coalesce(F.sum(used), F.lit(0))).alias("n_excluded"),
        F.count_if((F.col("n") > 0) & (F.col("x") > 0)).alias("n_doses"),
        F.max(F.when(valid, F.col("x"))).alias("x_max"),
        F.max(F.when(valid & (F.col("n") > 0), F.col("x"))).alias("x_scale"),
    )


def _search(doses: DataFrame, facts: DataFrame, keys: list[str], km_span: tuple[float, float]) -> DataFrame:
    """``km`` of every group with its last movement and a ``vmax`` near the best."""
    low, high = (F.col("x_scale") * F.lit(end) for end in km_span)
    params = facts.select(*keys, low.alias("km"), low.alias("km_lo"), high.alias("km_hi"))
    step = (km_span[1] / km_span[0]) ** (1 / COARSE_STEPS)
    params = settle(_grid_round(doses, params, keys, [step**i for i in range(COARSE_STEPS + 1)]), "fit-grid")
    fine = [step ** (i / FINE_STEPS) for i in range(-FINE_STEPS, FINE_STEPS + 1)]
    params = settle(_grid_round(doses, params, keys, fine), "fit-grid")
    for _ in range(NEWTON_ROUNDS):
        params = settle(_newton_round(doses, params, keys), "fit-newton")
        if params.filter(F.col("moved") > STILL).isEmpty():
            break
    return params


def _with_errors(shapes: DataFrame, km_span: tuple[float, float]) -> DataFrame:
    det = F.col("h_vv") * F.col("h_kk") - F.col("h_vk") * F.col("h_vk")
    solvable = (
        (F.col("df_resid") > 0)
        & (F.col("n_doses") > 1)
        & (F.col("h_kk") > 0)
        & (det > F.lit(1e-13) * F.col("h_vv") * F.col("h_kk"))
    )
    s2 = F.col("rss") / F.col("df_resid")
    low_end = F.col("x_scale") * F.lit(km_span[0] * (1 + 1e-6))
    high_end = F.col("x_scale") * F.lit(km_span[1] * (1 - 1e-6))
    undetermined = (F.col("n_doses") < 2) | (F.col("df_resid") < 1)
    return (
        shapes.withColumn("df_resid", F.col("n") - 2)
        .withColumn("se_vmax", F.when(solvable, F.sqrt(2 * s2 * F.col("h_kk") / det)))
        .withColumn("se_km", F.when(solvable, F.sqrt(2 * s2 * F.col("h_vv") / det)))
        .withColumn("t_vmax", F.try_divide("vmax", "se_vmax"))
        .withColumn("t_km", F.try_divide("km", "se_km"))
        .withColumn(
            "status",
            F.when(undetermined, "singular")
            .when((F.col("km") <= low_end) | (F.col("km") >= high_end), "at_bound")
            .when(F.col("se_km").isNull(), "singular")
            .when(~(F.col("moved") <= SETTLED), "unconverged")
            .otherwise("ok"),
        )
        .withColumns(
            {
                f"ci_{side}_{name}": F.col(name) + F.lit(sign * fixed.NORMAL_95) * F.col(f"se_{name}")
                for name in ("km", "vmax")
                for side, sign in (("low", -1), ("high", 1))
            }
        )
    )


def saturation_fit_of_doses(
    doses: DataFrame,
    keys: list[str],
    covariance: str = "observed",
    km_span: tuple[float, float] = (1e-6, 1e4),
    p_values: bool = True,
    keep_failed: bool = False,
) -> DataFrame:
    """:func:`saturation_fit` from a settled table of :func:`limnokit.operators.doses.compact_doses`."""
    if covariance not in ("observed", "gauss_newton"):
        raise ValueError("covariance is 'observed' or 'gauss_newton'")
    facts = settle(_facts(doses, keys), "dose-groups")
    curved = facts.filter(F.col("n_doses") > 0)
    used = doses.filter((F.col("x") >= 0) & (F.col("n") > 0)).select(*keys, "x", "n", "y_mean", "spread")
    # Settled, since the errors below use each of its columns many times over
    shapes = settle(_shape(used, _search(used, curved, keys, km_span), keys, covariance), "fit-shapes")
    fits = _with_errors(null_safe_join(shapes, curved, keys, "inner"), km_span)
    columns = [
        *keys, "n", "n_excluded", "n_doses", "x_max", "vmax", "km", "se_vmax", "se_km", "t_vmax", "t_km",
        "ci_low_km", "ci_high_km", "ci_low_vmax", "ci_high_vmax", "rss", "df_resid", "status",
    ]
    out = fits.select(*columns)
    if p_values:
        out = with_p_values(out, {"t_vmax": "p_vmax", "t_km": "p_km"})
    if keep_failed:
        failed = facts.filter(F.col("n_doses") == 0)
        failed = failed.select(*keys, "n", "n_excluded", "n_doses", "x_max", F.lit("failed").alias("status"))
        out = out.unionByName(failed, allowMissingColumns=True)
    return out


def saturation_fit(
    df: DataFrame,
    keys: list[str],
    x: str,
    y: str,
    covariance: str = "observed",
    km_span: tuple[float, float] = (1e-6, 1e4),
    p_values: bool = True,
    keep_failed: bool = False,
) -> DataFrame:
    """Least-squares ``vmax`` and ``km`` per group with SE, t, p and 95 % intervals.

    ``km`` is searched between ``km_span`` times the group's largest dose.
    ``covariance`` is the inverse ``observed`` Hessian of the residual sum of
    squares, or its ``gauss_newton`` part. ``status``:

    * ``ok``: an optimum inside the searched range, with SEs;
    * ``at_bound``: the residuals fall towards an end of the range (nearly
      straight or flat data); the estimates are those at the end;
    * ``singular``: estimates without SE (no residual df, a single dose, or
      a curvature that cannot be inverted);
    * ``unconverged``: inside the range, but one more step would still move ``km``;
    * ``failed``: no reading with a positive dose. No row unless kept.
    """
    return saturation_fit_of_doses(settled_doses(df, keys, x, y), keys, covariance, km_span, p_values, keep_failed)
