"""SQL that states each query's result on its own terms, for DuckDB."""

from __future__ import annotations

from driver_queries.bindings import (
    FITS,
    LAKE,
    LAKE_SHORE,
    READINGS,
    READINGS_LAST,
    READINGS_NEXT,
    sql_list,
)
from limnokit import fixed_values as fixed


def r(expr: str, digits: int, name: str | None = None) -> str:
    """Rounded expression without a negative zero."""
    text = f"(round({expr}, {digits}) + 0.0)"
    return f"{text} AS {name}" if name else text


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def case_map(column: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    whens = " ".join(f"WHEN {column} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


# --- shared pieces ----------------------------------------------------------

RAW = f"""
raw AS (
  SELECT *, {sql_list(READINGS_LAST)} FROM (
    SELECT *, {sql_list(READINGS_NEXT)} FROM (
      SELECT {sql_list(READINGS)} FROM lineitem)))"""

HOURS = """
CASE WHEN h > 7 + 41/60.0::DOUBLE THEN 6 + 46/60.0::DOUBLE ELSE h END"""


def clock_sql(text: str) -> str:
    """Hours of a clock text, 06:46 when it cannot be read."""
    hour = f"regexp_extract({text}, '^\\s*(2[0-3]|[01]?\\d):([0-5]?\\d)', 1)"
    minute = f"regexp_extract({text}, '^\\s*(2[0-3]|[01]?\\d):([0-5]?\\d)', 2)"
    return (
        f"CASE WHEN {text} IS NULL OR {hour} = '' THEN 6 + 46/60.0::DOUBLE "
        f"ELSE CAST({hour} AS DOUBLE) + CAST({minute} AS DOUBLE) / 60.0::DOUBLE END"
    )


CONVERTED = (
    RAW
    + f""",
lake AS (
  SELECT {LAKE_SHORE} AS shore, inc_month, {sql_list(LAKE)} FROM raw GROUP BY 1, 2),
converted AS (
  SELECT r.*, l.shore, l.temp_deg_c, l.ph,
    (1 - 1 / (pow(10.0::DOUBLE, 0.09018::DOUBLE + 2727.92::DOUBLE / (l.temp_deg_c + 273.15::DOUBLE) - l.ph) + 1))
      * CASE WHEN r.analyte = 'NH3' THEN r.conc_mgn_l END AS nh4_mgn_l
  FROM (SELECT *, {LAKE_SHORE} AS my_shore FROM raw) r
  LEFT JOIN lake l ON l.shore IS NOT DISTINCT FROM r.my_shore AND l.inc_month IS NOT DISTINCT FROM r.inc_month
  WHERE r.inc_month <> '')"""
)

CLEANED = (
    CONVERTED
    + f""",
cleaned AS (
  SELECT *, {HOURS} AS real_icu_hrc FROM (
    SELECT *, 1000 * CASE
        WHEN c < 0.002 AND analyte = 'NH3' THEN 0.001::DOUBLE
        WHEN c < 0.002 THEN c
        WHEN c < 0.003 AND analyte = 'NO3' THEN 0.0015::DOUBLE
        ELSE c END AS conc_ugn_l,
      {clock_sql("actual_incubation_hrs")} AS h
    FROM (SELECT *, least(nh4_mgn_l, no2_no3_mgn_l) AS c FROM converted))
  WHERE conc_ugn_l > 0)"""
)

RATES = (
    CLEANED
    + """,
baseline AS (
  SELECT shore, inc_month, analyte, spike_ug_l, avg(conc_ugn_l) AS b FROM cleaned WHERE type = 'spike' GROUP BY ALL),
delta AS (
  SELECT *, conc_ugn_l - mean_spike_conc AS delta_conc,
    (conc_ugn_l - mean_spike_conc) / real_icu_hrc AS delta_conc_hr,
    CASE location WHEN 'SH' THEN 'GB' WHEN 'SS' THEN 'BW' ELSE location END AS assigned
  FROM (
    SELECT c.*, CASE WHEN c.spike_ug_l = 0 THEN 0.0::DOUBLE
        WHEN c.spike_ug_l = 100 AND b.b IS NULL THEN 117.5::DOUBLE ELSE b.b END AS mean_spike_conc,
      CASE WHEN c.spike_ug_l = 0 THEN 'none' WHEN c.spike_ug_l = 100 AND b.b IS NULL THEN 'patch'
        ELSE concat(c.shore, '/', CAST(c.spike_ug_l AS VARCHAR)) END AS dose_group
    FROM cleaned c LEFT JOIN baseline b ON b.shore IS NOT DISTINCT FROM c.shore AND b.inc_month = c.inc_month
      AND b.analyte = c.analyte AND b.spike_ug_l = c.spike_ug_l)),
water AS (
  SELECT inc_month, location, analyte, dose_group, avg(delta_conc_hr) AS w FROM delta WHERE type = 'water' GROUP BY ALL),
rates AS (
  SELECT d.*, w.w AS water_delta_conc_hr, d.delta_conc_hr - w.w AS net_delta_conc_hr
  FROM delta d LEFT JOIN water w ON w.location = d.assigned AND w.inc_month = d.inc_month AND w.analyte = d.analyte
    AND w.dose_group = d.dose_group
  WHERE d.type IN ('biofilm', 'sediment'))"""
)


def rule_sql(rate: str, spike: str) -> str:
    """The outlier rules as one three-valued condition."""
    tests = {"rate_lt": f"{rate} <", "rate_gt": f"{rate} >", "spike_eq": f"{spike} =", "spike_ne": f"{spike} <>"}
    clauses = []
    for rule in fixed.OUTLIER_RULES:
        parts = [f"{k} = '{rule[k]}'" for k in ("site", "inc_month", "type", "analyte")]
        parts += [f"{test} {rule[name]}" for name, test in tests.items() if name in rule]
        clauses.append("(" + " AND ".join(parts) + ")")
    return "(" + "\n   OR ".join(clauses) + ")"


RATE_LIKE = (
    RAW
    + f""",
rate_like AS (
  SELECT *, CASE WHEN om_percent <> 0 THEN scatter * 5000 END AS net_rate_om FROM raw),
flagged AS (SELECT *, {rule_sql("net_rate_om", "spike_ug_l")} AS flag FROM rate_like)"""
)

KEPT = (
    RATES
    + f""",
normal AS (
  SELECT *, CASE WHEN afdm_g = 0 THEN NULL ELSE -net_delta_conc_hr * volume_lake_water_l / afdm_g END AS net_rate_om
  FROM rates),
kept AS (
  SELECT replace(site, '_', '') AS site, inc_month, type, analyte, mean_spike_conc AS x, net_rate_om AS y
  FROM (SELECT *, {rule_sql("net_rate_om", "spike_ug_l")} AS flag FROM normal) WHERE NOT flag)"""
)


def ols_cte(source: str, keys: str, x: str, y: str, name: str = "ols") -> str:
    """Least-squares lines with SE and t per group."""
    return f"""
{name}_m AS (
  SELECT {keys}, CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy,
    regr_sxy({y}, {x}) AS sxy, regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my,
    min({x}) AS x_min, max({x}) AS x_max
  FROM {source} GROUP BY {keys}),
{name}_s AS (
  SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept,
    greatest(syy - sxy * sxy / sxx, 0) / nullif(n - 2, 0) AS s2
  FROM {name}_m WHERE sxx > 0),
{name} AS (
  SELECT *, n - 2 AS df_resid, sqrt(s2 / sxx) AS se_slope, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se_intercept
  FROM {name}_s)"""


def mm_cte(source: str, keys: list[str], x: str, y: str, observed: bool = True, span: float = 1e4) -> str:
    """Saturation curves per group: nested grids on km, then Newton steps on (vmax, km)."""
    k = ", ".join(keys)
    kd = ", ".join(f"d.{c}" for c in keys)
    on = " AND ".join(f"d.{c} = p.{c}" for c in keys)
    o = "1" if observed else "0"
    parts = [
        f"""
mm_d AS MATERIALIZED (
  SELECT {k}, {x} AS x, count(*) AS n, avg({y}) AS yb, var_pop({y}) * count(*) AS m2
  FROM {source} WHERE {x} >= 0 AND {y} IS NOT NULL GROUP BY {k}, {x}),
mm_g0 AS MATERIALIZED (
  SELECT {k}, sum(n) AS n, count(*) FILTER (x > 0) AS n_doses, max(x) AS x_max,
    ln(max(x) * 1e-6) AS lo, ln(max(x) * {span}) AS hi
  FROM mm_d GROUP BY {k} HAVING max(x) > 0)"""
    ]
    for i, steps in enumerate([92, 20, 20, 20]):
        parts.append(f"""
mm_g{i + 1} AS MATERIALIZED (
  SELECT {k}, arg_max(lk, gain) - arg_max(w, gain) AS lo, arg_max(lk, gain) + arg_max(w, gain) AS hi,
    arg_max(lk, gain) AS lk
  FROM (
    SELECT {kd}, lk, any_value(w) AS w, pow(sum(d.n * d.yb * d.x / (exp(lk) + d.x)), 2)
      / sum(d.n * pow(d.x / (exp(lk) + d.x), 2)) AS gain
    FROM mm_d d JOIN (
      SELECT {k}, lo + (hi - lo) * s.s / {steps} AS lk, (hi - lo) / {steps} AS w
      FROM mm_g{i}, range({steps + 1}) s(s)) p ON {on}
    GROUP BY {kd}, lk) GROUP BY {k})""")
    parts.append(f"""
mm_n0 AS MATERIALIZED (
  SELECT {kd}, exp(any_value(lk)) AS km, sum(d.n * d.yb * d.x / (exp(lk) + d.x))
    / sum(d.n * pow(d.x / (exp(lk) + d.x), 2)) AS vmax
  FROM mm_d d JOIN mm_g4 p ON {on} GROUP BY {kd})""")
    for i in range(4):
        parts.append(f"""
mm_n{i + 1} AS MATERIALIZED (
  SELECT {k}, vmax - (h_kk * g_v - h_vk * g_k) / (h_vv * h_kk - h_vk * h_vk) AS vmax,
    km - (h_vv * g_k - h_vk * g_v) / (h_vv * h_kk - h_vk * h_vk) AS km
  FROM (
    SELECT {kd}, any_value(vmax) AS vmax, any_value(km) AS km,
      -2 * sum(d.n * (d.yb - vmax * d.x / (km + d.x)) * d.x / (km + d.x)) AS g_v,
      2 * sum(d.n * (d.yb - vmax * d.x / (km + d.x)) * vmax * d.x / pow(km + d.x, 2)) AS g_k,
      2 * sum(d.n * pow(d.x / (km + d.x), 2)) AS h_vv,
      2 * sum(d.n * ((d.yb - vmax * d.x / (km + d.x)) * d.x / pow(km + d.x, 2)
        - vmax * d.x * d.x / pow(km + d.x, 3))) AS h_vk,
      2 * sum(d.n * (pow(vmax * d.x / pow(km + d.x, 2), 2)
        - (d.yb - vmax * d.x / (km + d.x)) * 2 * vmax * d.x / pow(km + d.x, 3))) AS h_kk
    FROM mm_d d JOIN mm_n{i} p ON {on} GROUP BY {kd}))""")
    parts.append(f"""
mm AS MATERIALIZED (
  SELECT q.*, g.n, g.n_doses, g.x_max, g.n - 2 AS df_resid,
    sqrt(2 * rss / (g.n - 2) * h_kk / (h_vv * h_kk - h_vk * h_vk)) AS se_vmax,
    sqrt(2 * rss / (g.n - 2) * h_vv / (h_vv * h_kk - h_vk * h_vk)) AS se_km
  FROM (
    SELECT {kd}, any_value(vmax) AS vmax, any_value(km) AS km,
      sum(d.m2 + d.n * pow(d.yb - vmax * d.x / (km + d.x), 2)) AS rss,
      2 * sum(d.n * pow(d.x / (km + d.x), 2)) AS h_vv,
      2 * sum(d.n * ({o} * (d.yb - vmax * d.x / (km + d.x)) * d.x / pow(km + d.x, 2)
        - vmax * d.x * d.x / pow(km + d.x, 3))) AS h_vk,
      2 * sum(d.n * (pow(vmax * d.x / pow(km + d.x, 2), 2)
        - {o} * (d.yb - vmax * d.x / (km + d.x)) * 2 * vmax * d.x / pow(km + d.x, 3))) AS h_kk
    FROM mm_d d JOIN mm_n4 p ON {on} GROUP BY {kd}) q
  JOIN mm_g0 g ON {" AND ".join(f"q.{c} = g.{c}" for c in keys)})""")
    return ",".join(parts)


MM_POINTS = """
pts AS (SELECT l_returnflag, l_linestatus, l_quantity AS x,
  900.0::DOUBLE * l_quantity / (20 + l_quantity) + 1000.0::DOUBLE * (l_discount - 0.05::DOUBLE) AS y FROM lineitem)"""
FLAG_STATUS = ["l_returnflag", "l_linestatus"]


def p_value_cte(source: str, keys: str, t: str, df: str, name: str) -> str:
    """Two-sided t tail area, by summing the density over 20,000 even steps."""
    return f"""
{name}_d AS (
  SELECT {keys}, t, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS scale, df
  FROM (SELECT {keys}, least(abs({t}), 60) AS t, {df}::DOUBLE AS df FROM {source})),
{name} AS (
  SELECT {keys}, greatest(1 - 2 * any_value(scale) * any_value(t) / 20000 * sum(
    CASE WHEN s.s IN (0, 20000) THEN 0.5 ELSE 1 END * pow(1 + pow(t * s.s / 20000, 2) / df, -(df + 1) / 2)), 0) AS p
  FROM {name}_d, range(20001) s(s) GROUP BY {keys})"""


def grid_sql(cte: str, source: str, keys: str, y: str, digits: int, x_min: str = "0", points: int = 100) -> str:
    x = f"({x_min} + s.s * (x_max - {x_min}) / {points - 1})"
    return f"""WITH {cte}
SELECT {keys}, CAST(s.s AS INTEGER) AS point, {r(x, digits, "x")}, {r(y.format(x=x), digits, "y")}
FROM {source}, range({points}) s(s)"""


ORDERS_NATIONS = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def catalogue_cte(excluded: list[str]) -> str:
    return f"""
fits AS (SELECT {sql_list(FITS)} FROM {ORDERS_NATIONS}),
cat0 AS (
  SELECT *, split_part(model_name, '_', 1) AS site, split_part(model_name, '_', 2) AS month,
    split_part(model_name, '_', 3) AS substrate, split_part(model_name, '_', 4) AS n_type
  FROM fits WHERE model_name NOT IN {in_list(excluded)}),
cat1 AS (SELECT *, {case_map("site", fixed.SITE_LABELS, "site")} AS site_id FROM cat0),
cat AS (
  SELECT *, split_part(site_id, '_', 1) AS stream, nullif(split_part(site_id, '_', 2), '') AS depth_loc FROM cat1)"""


SHARES = """
shares AS (
  SELECT stream, depth_loc, substrate, n_type, count(*) AS total,
    count(*) FILTER (p_value_vmax < 0.05) AS n_vmax_sig, count(*) FILTER (p_value_km < 0.05) AS n_km_sig,
    count(*) FILTER (p_value_vmax < 0.05 AND p_value_km < 0.05) AS n_vmax_km_sig
  FROM cat GROUP BY ALL)"""


def box_sql(events: str = "SELECT * FROM events") -> str:
    return f"""
WITH v AS ({events}),
q AS (
  SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3
  FROM v GROUP BY event_type),
e AS (
  SELECT e.event_type, e.value, q.n, q.q1, q.median, q.q3,
    e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS within
  FROM v e JOIN q USING (event_type))
SELECT event_type, any_value(n) AS n, {r("any_value(q1)", 6, "q1")}, {r("any_value(median)", 6, "median")},
  {r("any_value(q3)", 6, "q3")}, {r("least(min(value) FILTER (within), any_value(q1))", 6, "whisker_low")},
  {r("greatest(max(value) FILTER (within), any_value(q3))", 6, "whisker_high")},
  count(*) FILTER (NOT within) AS n_outliers
FROM e GROUP BY event_type"""


NON_FINITE = """
  SELECT event_type, CASE WHEN event_id % 50 = 0 THEN 'inf'::DOUBLE WHEN event_id % 53 = 0 THEN '-inf'::DOUBLE
    WHEN event_id % 59 = 0 THEN 1.7e308 WHEN event_id % 61 = 0 THEN -1.7e308 ELSE value END AS value FROM events"""


def profile_sql(columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "column", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_missing,
  {r("avg(v)", 4, "mean")}, {r("stddev_samp(v)", 4, "sd")}, {r("min(v)", 4, "min")}, {r("max(v)", 4, "max")},
  {r("quantile_cont(v, 0.25)", 4, "q1")}, {r("quantile_cont(v, 0.5)", 4, "median")},
  {r("quantile_cont(v, 0.75)", 4, "q3")}
FROM (SELECT {expr} AS v FROM lineitem)"""
        for name, expr in columns.items()
    )


HISTOGRAM = """
WITH s AS (
  SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    (max(l_extendedprice) - min(l_extendedprice)) / ceil(log2(count(*)) + 1) AS cell
  FROM lineitem),
b AS (SELECT *, pow(10, floor(log10(cell))) AS base FROM s),
u2 AS (SELECT *, 2 * base - cell < 1.5 * (cell - base) AS ok2 FROM b),
u5 AS (SELECT *, ok2 AND 5 * base - cell < 2.75 * (cell - 2 * base) AS ok5 FROM u2),
u10 AS (SELECT *, ok5 AND 10 * base - cell < 1.5 * (cell - 5 * base) AS ok10 FROM u5),
w AS (SELECT lo, hi, base * CASE WHEN ok10 THEN 10 WHEN ok5 THEN 5 WHEN ok2 THEN 2 ELSE 1 END AS w FROM u10),
f AS (SELECT *, floor(lo / w + 1e-7) AS first, ceil(hi / w - 1e-7) AS last FROM w),
cells AS (
  SELECT CAST(i.i + 1 AS INTEGER) AS cell, (first + i.i) * w AS lower, (first + i.i + 1) * w AS upper, first * w AS low0
  FROM f, range(1000) i(i) WHERE first + i.i < last)
SELECT c.cell, c.lower, c.upper, count(l.l_extendedprice) AS n
FROM cells c LEFT JOIN lineitem l
  ON (l.l_extendedprice > c.lower + 1e-7 * (c.upper - c.lower) OR c.cell = 1)
  AND l.l_extendedprice <= c.upper + 1e-7 * (c.upper - c.lower)
GROUP BY ALL"""

def loess_sql(ctes: str, key: str, source: str, x: str, y: str) -> str:
    """Local quadratic regression on 80 points per group, neighbourhoods of 75 %."""
    return f"""
WITH {ctes} c AS (
  SELECT {key}, CAST({x} AS DOUBLE) AS x, count(*) AS n, avg({y}) AS y FROM {source} GROUP BY ALL),
g AS (
  SELECT {key}, floor(sum(n) * 0.75 + 1e-5) AS q, min(x) AS lo, max(x) AS hi FROM c GROUP BY {key}),
p AS (SELECT {key}, q, s.s AS point, lo + s.s * (hi - lo) / 79 AS at_x FROM g, range(80) s(s)),
d AS (
  SELECT p.*, c.x, c.y, c.n, abs(c.x - p.at_x) AS dist FROM p JOIN c USING ({key})),
h AS (
  SELECT {key}, point, min(dist) AS h FROM (
    SELECT *, sum(n) OVER (PARTITION BY {key}, point ORDER BY dist
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d)
  WHERE upto >= q GROUP BY ALL),
w AS (
  SELECT {key}, point, at_x, y, x - at_x AS z, n * pow(1 - pow(dist / h, 3), 3) AS w
  FROM d JOIN h USING ({key}, point) WHERE dist < h),
m AS (
  SELECT {key}, point, at_x, sum(w) AS a, sum(w * z) AS b, sum(w * z * z) AS c, sum(w * z * z * z) AS d,
    sum(w * z * z * z * z) AS e, sum(w * y) AS t, sum(w * y * z) AS u, sum(w * y * z * z) AS v
  FROM w GROUP BY ALL)
SELECT {key}, CAST(point AS INTEGER) AS point, {r("at_x", 5, "x")},
  {r("(t * (c * e - d * d) - u * (b * e - c * d) + v * (b * d - c * c))"
     " / (a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c))", 5, "y")}
FROM m"""


LOESS = loess_sql("", "event_type", "events", "hour(ts)", "value")

MM_SELECT = ",\n  ".join(
    r(e, 4, n)
    for n, e in {
        "vmax": "vmax",
        "km": "km",
        "se_vmax": "se_vmax",
        "se_km": "se_km",
        "ci_low_km": "km - 1.96 * se_km",
        "ci_high_km": "km + 1.96 * se_km",
        "ci_low_vmax": "vmax - 1.96 * se_vmax",
        "ci_high_vmax": "vmax + 1.96 * se_vmax",
    }.items()
)

RATE_LIMITS = "least(nullif(l_discount, 0), nullif(l_tax, 0))"
CURVE_KEYS = ["site", "inc_month", "type", "analyte"]

CHEMISTRY = """
chem AS (
  SELECT o_orderkey AS sample, year(o_orderdate) AS water_year, CAST(o_orderdate AS DATE) AS day,
    CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'GBL' WHEN 2 THEN 'GBNS1' WHEN 3 THEN 'BWO' WHEN 4 THEN 'SSNS2'
      ELSE 'elsewhere' END AS site,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS po4_ugl_dl, o_totalprice / 7 AS no3_mgl_dl,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 9 END AS nh4_mgl_dl, o_totalprice / 11 AS doc_mgl_dl,
    o_totalprice AS temp_c FROM orders)"""

SNOW_TABLE = """
SELECT CAST(event_id AS INTEGER) AS site_id, CAST(ts AS DATE) AS date, CASE WHEN event_type <> 'view' THEN value END AS snow_water_equivalent
FROM events"""

ORACLE: dict[str, str] = {
    "ols_by_group": f"""WITH {ols_cte("lineitem", "l_returnflag, l_linestatus", "l_quantity", "l_extendedprice")}
SELECT l_returnflag, l_linestatus, n, {r("slope", 4, "slope")}, {r("intercept", 4, "intercept")},
  {r("se_slope", 4, "se_slope")}, {r("se_intercept", 4, "se_intercept")}, {r("slope / se_slope", 4, "t_slope")},
  {r("intercept / se_intercept", 4, "t_intercept")}, df_resid FROM ols""",
    "ols_pvalues": f"""WITH {ols_cte("lineitem", "l_returnflag, l_linestatus", "l_quantity", "l_discount")},
{p_value_cte("ols", "l_returnflag, l_linestatus", "slope / se_slope", "df_resid", "ps")},
{p_value_cte("ols", "l_returnflag, l_linestatus", "intercept / se_intercept", "df_resid", "pi")}
SELECT l_returnflag, l_linestatus, n, df_resid, {r("ps.p", 6, "p_slope")}, {r("pi.p", 6, "p_intercept")}
FROM ols JOIN ps USING (l_returnflag, l_linestatus) JOIN pi USING (l_returnflag, l_linestatus)""",
    "mm_fit": f"""WITH {MM_POINTS}, {mm_cte("pts", FLAG_STATUS, "x", "y")}
SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS n, n_doses, CAST(df_resid AS BIGINT) AS df_resid, 'ok' AS status,
  {MM_SELECT} FROM mm""",
    "mm_fit_gauss_newton": f"""WITH {MM_POINTS}, {mm_cte("pts", FLAG_STATUS, "x", "y", observed=False)}
SELECT l_returnflag, l_linestatus, {r("vmax", 4, "vmax")}, {r("km", 4, "km")}, {r("se_vmax", 4, "se_vmax")},
  {r("se_km", 4, "se_km")} FROM mm""",
    "predict_grid": grid_sql(
        "ev AS (SELECT event_type, CAST(hour(ts) AS DOUBLE) AS h, value FROM events),"
        + ols_cte("ev", "event_type", "h", "value"),
        "ols",
        "event_type",
        "intercept + slope * {x}",
        6,
    ),
    "predict_grid_curve": grid_sql(
        MM_POINTS + "," + mm_cte("pts", FLAG_STATUS, "x", "y"),
        "mm",
        "l_returnflag, l_linestatus",
        "vmax * {x} / (km + {x})",
        4,
    ),
    "trend_line": grid_sql(
        ols_cte("lineitem", "l_returnflag", "l_quantity", "l_extendedprice"),
        "ols",
        "l_returnflag",
        "intercept + slope * {x}",
        3,
        x_min="x_min",
        points=80,
    ),
    "loess_grid": LOESS,
    "group_stats_attach": f"""
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice,
  {r("avg(l_extendedprice) OVER w", 4, "mean_price")}, {r("stddev_samp(l_extendedprice) OVER w", 4, "sd_price")}
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)""",
    "baseline_delta": f"""
WITH b AS (
  SELECT l_linestatus, l_quantity, avg(l_extendedprice / 997) AS m FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <> 7
  GROUP BY ALL),
j AS (
  SELECT l.*, l.l_extendedprice / 997 AS price, CASE WHEN l.l_quantity = 1 THEN 0 WHEN l.l_quantity = 7 THEN 117.5 ELSE b.m END AS base
  FROM lineitem l LEFT JOIN b USING (l_linestatus, l_quantity))
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, price,
  {r("base", 4, "baseline")}, {r("price - base", 4, "delta")},
  {r("(price - base) / l_quantity", 4, "delta_per_unit")} FROM j""",
    "control_correct": f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS m FROM events GROUP BY ALL),
a AS (SELECT *, CASE WHEN event_type IN ('click', 'signup') THEN 'view' ELSE event_type END AS assigned_type FROM d)
SELECT a.day, a.event_type, a.assigned_type, {r("a.m", 6, "daily_mean")}, {r("c.m", 6, "control_mean")},
  {r("a.m - c.m", 6, "net")}
FROM a LEFT JOIN d c ON c.day = a.day AND c.event_type = a.assigned_type""",
    "lod_substitute": f"""
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag,
    CASE WHEN c < 0.02 AND l_returnflag = 'A' THEN 0.001 WHEN c < 0.02 AND l_returnflag = 'N' THEN NULL
      WHEN c < 0.02 THEN c WHEN c < 0.03 AND l_returnflag = 'R' THEN 0.0015 ELSE c END::DOUBLE AS as_coded,
    CASE WHEN c < 0.02 AND l_returnflag = 'A' THEN 0.001 WHEN c < 0.03 AND l_returnflag = 'R' THEN 0.0015
      ELSE c END::DOUBLE AS by_own_limit
  FROM (SELECT *, {RATE_LIMITS} AS c FROM lineitem))
WHERE as_coded > 0""",
    "hours_clean": f"""
WITH e AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'n/a'
    ELSE concat(hour(ts), ':', lpad(CAST(minute(ts) AS VARCHAR), 2, '0')) END AS clock FROM events)
SELECT event_id, clock,
  CASE WHEN clock <> 'n/a' THEN concat(lpad(split_part(clock, ':', 1), 2, '0'), ':', split_part(clock, ':', 2), ':00')
    END AS normal,
  CASE WHEN clock <> 'n/a' THEN CAST(split_part(clock, ':', 1) AS DOUBLE)
    + CAST(split_part(clock, ':', 2) AS DOUBLE) / 60.0::DOUBLE END AS split_hours,
  {HOURS} AS hours
FROM (SELECT *, {clock_sql("clock")} AS h FROM e)""",
    "speciation": f"""WITH {CONVERTED}
SELECT l_orderkey, l_linenumber, shore, inc_month, analyte, {r("temp_deg_c", 6, "temp_deg_c")}, {r("ph", 6, "ph")},
  {r("nh4_mgn_l", 6, "nh4_mgn_l")} FROM converted""",
    "prefix_class": """
SELECT p_partkey, CASE WHEN p_type LIKE 'ECON%' OR p_type LIKE 'SMALL%' THEN 'E'
    WHEN p_type LIKE 'LARGE%' OR p_type LIKE 'MED%' THEN 'W' END AS shore,
  p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%' AS low_brand
FROM part""",
    "rule_flag": f"WITH {RATE_LIKE} SELECT l_orderkey, l_linenumber, site, flag FROM flagged",
    "rule_table_flag": f"WITH {RATE_LIKE} SELECT l_orderkey, l_linenumber, site, flag FROM flagged",
    "rule_report": f"""WITH {RATE_LIKE}
SELECT site, inc_month, analyte, type, count(*) AS filtered_count FROM flagged WHERE flag GROUP BY ALL""",
    "rule_split": f"""WITH {RATE_LIKE}
SELECT site, type, 'flagged' AS part, count(*) AS n FROM flagged WHERE flag GROUP BY ALL
UNION ALL
SELECT replace(site, '_', ''), type, 'kept', count(*) FROM flagged WHERE NOT flag GROUP BY 1, 2""",
    "depth_zone": """
WITH p AS (
  SELECT p_partkey, CASE WHEN p_size <= 15 THEN 0.5 WHEN p_size <= 30 THEN 3 WHEN p_size <= 45 THEN 10
      ELSE 99 END::DOUBLE AS depth,
    CASE WHEN p_size % 2 = 0 THEN replace(p_brand, '#', '') ELSE concat('7', p_brand) END AS site FROM part),
z AS (
  SELECT *, CASE depth WHEN 0.5 THEN 'INT' WHEN 3 THEN 'NS' WHEN 10 THEN 'SL' END AS location,
    CASE WHEN site LIKE 'Brand%' THEN 'Brand' END AS site_prefix FROM p)
SELECT *, concat(coalesce(site_prefix, 'NA'), coalesce(location, 'NA')) AS new_site FROM z""",
    "standardised": """
SELECT l_orderkey, l_linenumber, l_extendedprice AS net_rate_om, x AS mean_spike_conc,
  CASE WHEN x = 0 THEN 'control' WHEN x <> 0 THEN 'spiked' END AS is_control,
  CASE WHEN x > 0 THEN l_extendedprice / x END AS standardized_uptake
FROM (SELECT *, nullif(l_quantity, 2) - 1 AS x FROM lineitem)""",
    "metrics_long": f"""
WITH w AS (
  SELECT l_returnflag, -l_extendedprice AS raw_uptake, -(l_extendedprice / nullif(l_discount, 0)) AS weight_corrected,
    -l_extendedprice * l_quantity / nullif(l_tax, 0) AS afdm_corrected FROM lineitem),
l AS (
  SELECT * FROM w UNPIVOT INCLUDE NULLS (uptake FOR metric IN (raw_uptake, weight_corrected, afdm_corrected)))
SELECT l_returnflag, metric, count(*) AS n_rows, count(uptake) AS n_values, {r("avg(uptake)", 2, "mean_uptake")}
FROM l GROUP BY ALL""",
    "model_key_split": f"""
WITH {catalogue_cte(["BW0.5m_June_sediment_NO3", "GB10m_May_biofilm_NH3", "not_a_model"])},
s AS (SELECT model_name, avg(vmax) AS slope FROM fits GROUP BY ALL)
SELECT site, month, substrate, n_type, site_id, stream, depth_loc, count(*) AS n, {r("avg(slope)", 3, "mean_slope")}
FROM cat LEFT JOIN s USING (model_name) GROUP BY ALL""",
    "incubation_count": f"""WITH {catalogue_cte(fixed.EXCLUDED_MODELS)}
SELECT stream, depth_loc, substrate, n_type, count(*) AS n FROM cat GROUP BY ALL""",
    "sig_share": f"""WITH {catalogue_cte(fixed.EXCLUDED_MODELS)}, {SHARES}
SELECT *, {r("n_vmax_km_sig::DOUBLE / total", 8, "prop_mm_bothsig")} FROM shares""",
    "sig_rollup": f"""WITH {catalogue_cte(fixed.EXCLUDED_MODELS)}, {SHARES}
SELECT stream, substrate, n_type, CAST(sum(total) AS BIGINT) AS sum_total,
  CAST(sum(n_vmax_km_sig) AS BIGINT) AS sum_vmax_km_sig,
  {r("sum(n_vmax_km_sig)::DOUBLE / sum(total)", 8, "prop_sig")} FROM shares GROUP BY ALL""",
    "nation_share": f"""
SELECT n_name, count(*) AS sum_total, count(*) FILTER (o_totalprice > 250000) AS sum_large,
  {r("count(*) FILTER (o_totalprice > 250000)::DOUBLE / count(*)", 8, "share")}
FROM {ORDERS_NATIONS} GROUP BY n_name""",
    "box_stats": box_sql(),
    "box_stats_nonfinite": box_sql(NON_FINITE),
    "box_outliers": """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, value, event_id FROM events JOIN q USING (event_type)
WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "hist_bins": HISTOGRAM,
    "profile": profile_sql(
        {
            "l_quantity": "l_quantity",
            "l_extendedprice": "l_extendedprice",
            "l_discount": "nullif(l_discount, 0)",
            "l_tax": "l_tax",
        }
    ),
    "value_range": """
SELECT l_returnflag, l_linestatus, min(nullif(l_discount, 0)) AS min_value, max(nullif(l_discount, 0)) AS max_value
FROM lineitem GROUP BY ALL""",
    "keep_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag IN ('A', 'R')",
    "global_counts": f"""
SELECT {r("avg(nullif(l_tax, 0))", 6, "mean_tax")}, count(*) FILTER (l_tax > 0.04) AS n_high_tax FROM lineitem""",
    "daily_delta": f"""
WITH d AS (
  SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL),
g AS (
  SELECT event_type, day, CASE WHEN event_type = 'view' AND day = DATE '2024-01-20' THEN NULL ELSE v END AS level
  FROM d),
c AS (
  SELECT *, level - lag(level, 1, 0) OVER (PARTITION BY event_type ORDER BY day) AS daily_delta FROM g),
s AS (
  SELECT *, sum(daily_delta) OVER w AS total, count(*) FILTER (daily_delta IS NULL) OVER w AS gaps FROM c
  WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, {r("level", 4, "level")}, {r("daily_delta", 4, "daily_delta")},
  {r("CASE WHEN gaps = 0 THEN total END", 4, "cumulative")},
  CASE WHEN daily_delta > 0 THEN 'Accumulate' WHEN daily_delta <= 0 THEN 'Melt' END AS quality,
  CAST(CASE WHEN daily_delta < 0 THEN 1 WHEN daily_delta >= 0 THEN 0 END AS INTEGER) AS rain
FROM s""",
    "previous_and_total": """
WITH e AS (SELECT event_id, user_id, ts, CAST(nullif(floor(value), 7) AS DOUBLE) AS v FROM events)
SELECT event_id, lag(v) OVER w AS previous,
  CASE WHEN count(*) FILTER (v IS NULL) OVER w = 0 THEN sum(v) OVER w END AS total
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "scaled_union": """
SELECT event_id, value AS discharge_cfs, 'GB' AS site, 'east' AS label, value * 0.0283168::DOUBLE AS discharge_cms,
  value * 0.0283168::DOUBLE / 10.64485::DOUBLE AS scale_q FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id, value, 'BW', 'west', value * 0.0283168::DOUBLE, value * 0.0283168::DOUBLE / 29.00787::DOUBLE
FROM events WHERE event_type = 'click'""",
    "chem_long": """
WITH o AS (
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS site, CAST(o_orderdate AS DATE) AS date,
    o_totalprice / 1000 AS po4, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS doc FROM orders),
k AS (
  SELECT o_orderkey, site, CASE site WHEN '1-URGENT' THEN 'SH(NS)' WHEN '2-HIGH' THEN 'SS(NS)'
      WHEN '3-MEDIUM' THEN 'GB(NS)' END AS position, date, po4, doc
  FROM o WHERE site IS DISTINCT FROM '4-NOT SPECIFIED')
UNPIVOT k ON po4, doc INTO NAME variable VALUE concentration""",
    "month_profile": f"""
SELECT strftime(o_orderdate, '%b') AS month, CAST(month(o_orderdate) AS INTEGER) AS month_rank,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'GB' ELSE 'BW' END AS color_group, count(*) AS n,
  {r("avg(o_totalprice)", 3, "mean_price")}
FROM orders WHERE month(o_orderdate) <= 9 GROUP BY ALL""",
    "semi_dates": """
SELECT event_id, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-16', DATE '2024-01-25')""",
    "semi_keys": """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "anti_keys": """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "recode_table": """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS place,
  CASE WHEN n_regionkey < 2 THEN concat('near ', n_name) ELSE CAST(c_nationkey AS VARCHAR) END AS place_label
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "scalar_math": f"""
SELECT l_orderkey, l_linenumber, {r("pow(10.0::DOUBLE, l_tax)", 8, "ten_power")}, 1000 * l_discount AS ug,
  l_quantity / 1000 AS mg, l_quantity * 0.0283168::DOUBLE AS cms,
  {r("1 / (pow(10.0::DOUBLE, 0.09018::DOUBLE + 2727.92::DOUBLE / (l_quantity + 273.15::DOUBLE) - l_tax * 100) + 1)",
     8, "fraction")},
  l_quantity / nullif(l_tax, 0) AS per_tax, CASE WHEN l_discount > 0 THEN l_quantity / l_discount END AS per_discount,
  -l_quantity AS negated, coalesce(nullif(l_tax, 0), 0.5::DOUBLE) AS tax_or_default,
  concat(CASE WHEN l_returnflag = 'N' THEN 'NA' ELSE l_returnflag END, '_', l_linestatus, '_', l_linenumber) AS pasted,
  l_returnflag AS letters
FROM lineitem""",
    "trim_head": f"""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS k FROM orders)
WHERE k > {fixed.BLANK_HEAD_ROWS}""",
    "cleaned_readings": f"""WITH {CLEANED}
SELECT l_orderkey, l_linenumber, analyte, {r("conc_ugn_l", 5, "conc_ugn_l")}, {r("real_icu_hrc", 5, "real_icu_hrc")}
FROM cleaned""",
    "uptake_rate_table": f"""WITH {RATES}
SELECT inc_month, site, location, depth, analyte, spike_ug_l, {r("mean_spike_conc", 5, "mean_spike_conc")},
  volume_lake_water_l, type, no2_no3_mgn_l, {r("nh4_mgn_l", 5, "nh4_mgn_l")}, {r("conc_ugn_l", 5, "conc_ugn_l")},
  {r("ph", 5, "ph")}, weight_g, afdm_g, {r("real_icu_hrc", 5, "real_icu_hrc")}, {r("delta_conc", 5, "delta_conc")},
  {r("delta_conc_hr", 5, "delta_conc_hr")}, {r("water_delta_conc_hr", 5, "water_delta_conc_hr")},
  {r("net_delta_conc_hr", 5, "net_delta_conc_hr")}
FROM rates""",
    "incubation_lines": f"""WITH {KEPT}, {ols_cte("kept", "site, inc_month, type, analyte", "x", "y")}
SELECT site, inc_month, type, analyte, n, {r("intercept", 6, "intercept")}, {r("slope", 6, "slope")},
  {r("se_intercept", 6, "se_intercept")}, {r("se_slope", 6, "se_slope")}, df_resid,
  CASE WHEN se_slope > 0 THEN 'ok' ELSE 'exact' END AS status FROM ols""",
    "mm_pvalues": f"""WITH {MM_POINTS}, {mm_cte("pts", FLAG_STATUS, "x", "y")},
{p_value_cte("mm", ", ".join(FLAG_STATUS), "vmax / se_vmax", "df_resid", "pv")},
{p_value_cte("mm", ", ".join(FLAG_STATUS), "km / se_km", "df_resid", "pk")}
SELECT l_returnflag, l_linestatus, {r("pv.p", 6, "p_vmax")}, {r("pk.p", 6, "p_km")}
FROM pv JOIN pk USING (l_returnflag, l_linestatus)""",
    "mm_fit_status": """
WITH p AS (
  SELECT CASE WHEN l_linenumber = 1 THEN 'no dose' WHEN l_linenumber = 2 THEN 'one dose'
      WHEN l_linenumber = 3 AND l_orderkey > 2 THEN NULL WHEN l_linenumber = 3 THEN 'few' ELSE 'many' END AS grp,
    CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 5 ELSE l_quantity END::DOUBLE AS x,
    CASE WHEN l_tax <> 0 THEN 900 * l_quantity / (12 + l_quantity) + l_tax END AS y FROM lineitem)
SELECT grp, count(y) FILTER (x >= 0) AS n, count(*) FILTER (y IS NULL) AS n_excluded,
  count(DISTINCT x) FILTER (x > 0 AND y IS NOT NULL) AS n_doses,
  CASE WHEN count(DISTINCT x) FILTER (x > 0 AND y IS NOT NULL) = 0 THEN 'failed'
    WHEN count(DISTINCT x) FILTER (x > 0 AND y IS NOT NULL) < 2 OR count(y) < 3 THEN 'singular' ELSE 'ok' END AS status
FROM p WHERE grp IS NOT NULL GROUP BY grp""",
    "discharge": f"""
SELECT CAST(ts AS DATE) AS date, value AS discharge_cfs, {case_map("event_type", {"view": "GB", "click": "BW"}, "NULL")} AS site,
  {case_map("event_type", {"view": "east", "click": "west"}, "NULL")} AS label, value * 0.0283168::DOUBLE AS discharge_cms,
  value * 0.0283168::DOUBLE / CASE event_type WHEN 'view' THEN 10.64485::DOUBLE ELSE 29.00787::DOUBLE END AS scale_q
FROM events WHERE event_type IN ('view', 'click') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
    "snow": f"""
WITH d AS (
  SELECT CASE event_type WHEN 'view' THEN 615 WHEN 'click' THEN 848 ELSE NULL END AS site_id, CAST(ts AS DATE) AS date,
    sum(value) AS level FROM events
  WHERE event_type IN ('view', 'click', 'error') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL),
s AS (SELECT *, CASE WHEN site_id = 615 THEN 'GB' WHEN site_id IS NOT NULL THEN 'BW' END AS site FROM d),
c AS (SELECT *, level - lag(level, 1, 0) OVER (PARTITION BY site ORDER BY date, site_id NULLS FIRST) AS delta FROM s),
t AS (SELECT *, sum(delta) OVER (PARTITION BY site ORDER BY date, site_id NULLS FIRST) AS total FROM c)
SELECT site_id, date, site, {r("level", 3, "snow_water_equivalent")}, {r("delta", 3, "daily_delta")}, {r("total", 3, "cumulative")},
  CASE WHEN delta > 0 THEN 'Accumulate' ELSE 'Melt' END AS quality, CAST(delta < 0 AS INTEGER) AS rain FROM t""",
    "chemistry": f"""
WITH {CHEMISTRY},
w AS (
  SELECT *, po4_ugl_dl / 1000 AS po4_mgl_dl, {case_map("site", fixed.SITE_POSITIONS)} AS position FROM chem
  WHERE water_year = 1995 AND (site IS NULL OR site NOT IN {in_list(fixed.EXCLUDED_CHEMISTRY_SITES)})),
long AS (
  SELECT * FROM (SELECT sample, site, position, day, po4_mgl_dl, no3_mgl_dl, nh4_mgl_dl, doc_mgl_dl FROM w)
  UNPIVOT (concentration FOR variable IN (po4_mgl_dl, no3_mgl_dl, nh4_mgl_dl, doc_mgl_dl)))
SELECT sample, site, position, day AS date, variable, {r("concentration", 6, "concentration")},
  CASE variable WHEN 'doc_mgl_dl' THEN 5.0 ELSE 0.125 END::DOUBLE AS y_limit,
  CAST({case_map("position", {p: i + 1 for i, p in enumerate(fixed.CHEMISTRY_POSITION_ORDER)})} AS INTEGER) AS position_rank
FROM long""",
    "temperature": f"""
WITH {CHEMISTRY},
w AS (SELECT *, {case_map("site", fixed.SITE_POSITIONS)} AS position FROM chem WHERE water_year = 1995)
SELECT sample, strftime(day, '%b') AS month, CAST(month(day) AS INTEGER) AS month_rank, position,
  CASE WHEN position LIKE '%GB%' THEN 'GB' ELSE 'BW' END AS color_group,
  CAST({case_map("position", {p: i + 1 for i, p in enumerate(fixed.TEMPERATURE_POSITION_ORDER)})} AS INTEGER) AS position_rank, temp_c
FROM w WHERE month(day) <= 9 AND position IS NOT NULL""",
    "temperature_smooth": loess_sql(
        f"""{CHEMISTRY},
t AS (
  SELECT CASE WHEN position LIKE '%GB%' THEN 'GB' ELSE 'BW' END AS color_group, month(day) AS m, temp_c
  FROM (SELECT *, {case_map("site", fixed.SITE_POSITIONS)} AS position FROM chem WHERE water_year = 1995)
  WHERE month(day) <= 9 AND position IS NOT NULL),""",
        "color_group",
        "t",
        "m",
        "temp_c",
    ),
    "report_order": f"""
SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS site_rank,
  CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS INTEGER) AS month_rank,
  CAST(CASE l_linestatus WHEN 'F' THEN 1 ELSE 3 END AS INTEGER) AS metric_rank FROM lineitem""",
    "mean_hours": f"""
SELECT {r("avg(hour(ts) + minute(ts) / 60.0::DOUBLE)", 6, "mean_hours")} FROM events""",
    "csv_round_trip": SNOW_TABLE,
    "csv_many_layouts": """
SELECT 'say "' || event_type || '", line' || chr(10) || user_id AS shore, CAST(event_id AS VARCHAR) AS inc_month,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(event_id % 40 AS DOUBLE) END AS temp_deg_c, value AS ph FROM events""",
    "csv_faults": """SELECT 'temp_deg_c' AS "column", count(*) AS n FROM events WHERE event_id % 10 = 3""",
    "parquet_hand_off": SNOW_TABLE,
    "parquet_hand_off_bucketed": f"""
SELECT date, count(*) AS n, {r("sum(snow_water_equivalent)", 4, "total")} FROM ({SNOW_TABLE}) GROUP BY date""",
    "rate_figures": f"""WITH {RAW},
spiked AS (
  SELECT concat(regexp_extract(site, '^[A-Za-z]+'), coalesce(CASE depth WHEN 0.5 THEN 'INT' WHEN 3 THEN 'NS' WHEN 10 THEN 'SL' END, 'NA')) AS new_site,
    inc_month, analyte, scatter * 5000 AS value FROM raw WHERE spike_ug_l > 0),
q AS (
  SELECT new_site, inc_month, analyte, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM spiked GROUP BY ALL),
e AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS within FROM spiked JOIN q USING (new_site, inc_month, analyte))
SELECT new_site, inc_month, analyte, any_value(n) AS n, {r("any_value(q1)", 6, "q1")}, {r("any_value(median)", 6, "median")}, {r("any_value(q3)", 6, "q3")},
  {r("least(min(value) FILTER (within), any_value(q1))", 6, "whisker_low")}, {r("greatest(max(value) FILTER (within), any_value(q3))", 6, "whisker_high")},
  count(*) FILTER (NOT within) AS n_outliers,
  CAST({case_map("new_site", {p: i + 1 for i, p in enumerate(fixed.SITE_ORDER)})} AS INTEGER) AS site_rank,
  CAST({case_map("inc_month", {p: i + 1 for i, p in enumerate(fixed.INCUBATION_MONTHS)})} AS INTEGER) AS month_rank
FROM e GROUP BY new_site, inc_month, analyte""",
    "replicate_stats": f"""WITH {RAW}
SELECT l_orderkey, l_linenumber, {r("avg(measured) OVER w", 6, "mean_conc")}, {r("stddev_samp(measured) OVER w", 6, "sd_conc")}
FROM raw WINDOW w AS (PARTITION BY site, location, inc_month, type, analyte, spike_ug_l)""",
    "mm_fit_continuous": f"""WITH pts AS (
  SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE AS x,
    900.0::DOUBLE * l_extendedprice / (20000 + l_extendedprice) + 1000.0::DOUBLE * (l_discount - 0.05::DOUBLE) AS y FROM lineitem),
{mm_cte("pts", FLAG_STATUS, "x", "y")}
SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS n, n_doses, 'ok' AS status,
  {", ".join(r(c, 3, c) for c in ("vmax", "km", "se_vmax", "se_km"))} FROM mm""",
    "rule_table_overlap": """
SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag IS NULL THEN NULL
  WHEN l_returnflag = 'A' THEN l_extendedprice < 20000 OR (l_extendedprice > 60000 AND l_quantity <> 50)
  WHEN l_returnflag = 'N' THEN l_quantity = 7 ELSE FALSE END AS flag FROM lineitem""",
    "incubation_curves": f"""WITH {KEPT}, {mm_cte("kept", CURVE_KEYS, "x", "y")}
SELECT site, inc_month, type, analyte, CAST(n AS BIGINT) AS n, n_doses, {r("vmax", 3, "vmax")}, {r("km", 3, "km")},
  {r("se_vmax", 3, "se_vmax")}, {r("se_km", 3, "se_km")}, 'ok' AS status FROM mm""",
    "saturating_share": f"""WITH {KEPT}, {mm_cte("kept", CURVE_KEYS, "x", "y")},
{p_value_cte("mm", ", ".join(CURVE_KEYS), "vmax / se_vmax", "df_resid", "pv")},
{p_value_cte("mm", ", ".join(CURVE_KEYS), "km / se_km", "df_resid", "pk")},
named AS (
  SELECT {case_map("site", fixed.SITE_LABELS, "site")} AS site_id, type AS substrate, analyte AS n_type,
    pv.p < 0.05 AND pk.p < 0.05 AS both_sig
  FROM pv JOIN pk USING (site, inc_month, type, analyte)
  WHERE concat_ws('_', site, inc_month, type, analyte) NOT IN {in_list(fixed.EXCLUDED_MODELS)})
SELECT split_part(site_id, '_', 1) AS stream, substrate, n_type, count(*) AS sum_total,
  count(*) FILTER (both_sig) AS sum_vmax_km_sig, {r("count(*) FILTER (both_sig)::DOUBLE / count(*)", 8, "prop_sig")}
FROM named GROUP BY ALL""",
}
