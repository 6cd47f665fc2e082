"""Test tables seen as domain tables.

Each binding is a select list that Spark and the SQL check both evaluate, so
they only rename and relabel; the computing under test is elsewhere. Text and
numbers are chosen so that every branch is met: blank months, unreadable and
overlong clock texts, values around and below the detection limits, zero
divisors, a missing baseline, underscores in site names. Prices are divided by
a prime where means of them are compared, so that no mean of two-decimal
prices lies on a rounding tie.
"""

from __future__ import annotations

# lineitem as raw vial readings
READINGS = {
    "sample_date": "CAST(l_shipdate AS DATE)",
    "inc_month": "CASE WHEN day(l_shipdate) = 31 THEN '' WHEN month(l_shipdate) <= 4 THEN 'May'"
    " WHEN month(l_shipdate) <= 8 THEN 'June' ELSE 'July' END",
    "location": "CASE l_linenumber WHEN 2 THEN 'BW' WHEN 3 THEN 'SH' WHEN 4 THEN 'SS' WHEN 5 THEN 'DI_blank'"
    " WHEN 7 THEN 'BW' ELSE 'GB' END",
    "vial_num": "l_linenumber",
    "type": "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'spike' WHEN l_returnflag = 'A' THEN 'water'"
    " WHEN l_returnflag = 'N' THEN 'biofilm' ELSE 'sediment' END",
    "analyte": "CASE WHEN l_discount <= 0.05 THEN 'NH3' ELSE 'NO3' END",
    "depth": "CASE WHEN l_tax <= 0.02 THEN CAST(0.5 AS DOUBLE) WHEN l_tax <= 0.05 THEN CAST(3 AS DOUBLE)"
    " WHEN l_tax <= 0.07 THEN CAST(10 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END",
    "depth_text": "CASE WHEN l_tax <= 0.02 THEN '0.5m' WHEN l_tax <= 0.05 THEN '3m' WHEN l_tax <= 0.07 THEN '10m'"
    " ELSE '1m' END",
    "spike_ug_l": "CASE WHEN l_quantity <= 10 THEN CAST(0 AS DOUBLE) WHEN l_quantity <= 20 THEN CAST(100 AS DOUBLE)"
    " WHEN l_quantity <= 30 THEN CAST(200 AS DOUBLE) WHEN l_quantity <= 40 THEN CAST(400 AS DOUBLE)"
    " ELSE CAST(800 AS DOUBLE) END",
    "scatter": "(l_extendedprice - CAST(50000 AS DOUBLE)) / CAST(5000011 AS DOUBLE)",
    "actual_incubation_hrs": "CASE WHEN day(l_shipdate) = 1 THEN 'n/a' WHEN day(l_shipdate) = 2 THEN ''"
    " WHEN day(l_shipdate) < 10 THEN concat('6:0', CAST(day(l_shipdate) AS VARCHAR(2)))"
    " WHEN day(l_shipdate) < 20 THEN concat('06:', CAST(day(l_shipdate) AS VARCHAR(2)), ':30')"
    " ELSE concat('7:', CAST(day(l_shipdate) + 20 AS VARCHAR(2))) END",
    "volume_lake_water_l": "CAST(0.05 AS DOUBLE) + l_tax",
    "weight_g": "l_tax * CAST(20 AS DOUBLE)",
    "afdm_g": "l_tax * CAST(10 AS DOUBLE)",
    "om_percent": "l_discount * CAST(100 AS DOUBLE)",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_tax": "l_tax",
    "l_quantity": "l_quantity",
}

# Columns that build on the ones above: site names and concentrations. Uptake
# takes 12 or 8 units per hour at saturation, half of it at a dose of 150.
READINGS_NEXT = {
    "site": "concat(location, CASE WHEN l_linenumber > 5 THEN '_' ELSE '' END, depth_text)",
    "measured": "CASE WHEN type = 'spike' AND spike_ug_l = 100 AND inc_month = 'July' AND analyte = 'NO3'"
    " AND location IN ('BW', 'SS') THEN NULL"
    " WHEN type = 'spike' THEN spike_ug_l / 1000 + scatter + CAST(0.005 AS DOUBLE)"
    " WHEN type = 'water' THEN spike_ug_l / 1000 + scatter"
    " WHEN type = 'biofilm' THEN spike_ug_l / 1000 + scatter"
    " - CAST(0.078 AS DOUBLE) * spike_ug_l / (150 + spike_ug_l)"
    " ELSE spike_ug_l / 1000 + scatter - CAST(0.052 AS DOUBLE) * spike_ug_l / (150 + spike_ug_l) END",
}
READINGS_LAST = {
    "conc_mgn_l": "measured",
    "nh3_mgn_l": "CASE WHEN analyte = 'NH3' THEN measured END",
    "no2_no3_mgn_l": "CASE WHEN analyte = 'NO3' THEN measured END",
}

# Lake conditions per shore and month: means over the readings themselves
LAKE_SHORE = (
    "CASE WHEN location IN ('GB', 'SH') THEN 'E' WHEN location = 'DI_blank' THEN 'L'"
    " WHEN location IN ('BW', 'SS') THEN 'W' END"
)
LAKE = {
    "temp_deg_c": "avg(l_quantity) / CAST(2 AS DOUBLE)",
    "ph": "CAST(7 AS DOUBLE) + avg(l_tax) * CAST(10 AS DOUBLE)",
}

# orders joined to customer and nation as a fit table: a model name and p-values
FITS = {
    "model_name": "concat(CASE n_regionkey WHEN 0 THEN 'BW0.5m' WHEN 1 THEN 'BW3m' WHEN 2 THEN 'GB0.5m'"
    " WHEN 3 THEN 'GB10m' ELSE 'XX7m' END, '_', CASE WHEN month(o_orderdate) <= 4 THEN 'May'"
    " WHEN month(o_orderdate) <= 8 THEN 'June' ELSE 'July' END, '_', CASE o_orderstatus WHEN 'F' THEN 'biofilm'"
    " ELSE 'sediment' END, '_', CASE c_mktsegment WHEN 'BUILDING' THEN 'NH3' WHEN 'MACHINERY' THEN 'NH3'"
    " ELSE 'NO3' END)",
    "p_value_vmax": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice / CAST(4000000 AS DOUBLE) END",
    "p_value_km": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE (c_acctbal + 1000) / CAST(100000 AS DOUBLE) END",
    "vmax": "o_totalprice",
}


def select_list(columns: dict[str, str]) -> list[str]:
    """``expression AS name`` texts."""
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def sql_list(columns: dict[str, str]) -> str:
    return ",\n  ".join(select_list(columns))
