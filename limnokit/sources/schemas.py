"""Table layouts: column name, type, and the header it has in delivered files."""

from __future__ import annotations

from pyspark.sql import types as T

# Column name -> (Spark type, header in the delivered file)
TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "incubation_raw": {
        "sample_date": ("date", "Sample_Date"),
        "inc_month": ("string", "Inc_month"),
        "site": ("string", "Site"),
        "location": ("string", "Location"),
        "vial_num": ("int", "Vial_num"),
        "type": ("string", "Type"),
        "analyte": ("string", "Analyte"),
        "depth": ("double", "Depth"),
        "spike_ug_l": ("double", "Spike_µg_L"),
        "nh3_spike_ug_l": ("double", "NH3_spike_µg_L"),
        "no3_spike_ug_l": ("double", "NO3_spike_µg_L"),
        "conc_mgn_l": ("double", "Conc_mgNL"),
        "nh3_mgn_l": ("double", "NH3_mgNL"),
        "no2_no3_mgn_l": ("double", "NO2_NO3_mgNL"),
        "actual_incubation_hrs": ("string", "Actual_incubation_hrs"),
        "volume_lake_water_l": ("double", "Volume_lake_water_L"),
        "weight_g": ("double", "Weight_g"),
        "afdm_g": ("double", "AFDM_g"),
        "om_percent": ("double", "OM_%"),
    },
    "lake_ph_temp": {
        "shore": ("string", "Shore"),
        "inc_month": ("string", "Inc_month"),
        "temp_deg_c": ("double", "Temp_degC"),
        "ph": ("double", "pH"),
    },
    "fit_mm": {
        "model_name": ("string", "model_name"),
        "vmax": ("double", "Vmax"),
        "km": ("double", "Km"),
        "std_error_km": ("double", "Std_Error_Km"),
        "p_value_km": ("double", "p_value_Km"),
        "std_error_vmax": ("double", "Std_Error_Vmax"),
        "p_value_vmax": ("double", "p_value_Vmax"),
        "ci_low_km": ("double", "CI_low_Km"),
        "ci_high_km": ("double", "CI_high_Km"),
        "ci_low_vmax": ("double", "CI_low_Vmax"),
        "ci_high_vmax": ("double", "CI_high_Vmax"),
        "status": ("string", "status"),
    },
    "fit_linear": {
        "model_name": ("string", "model_name"),
        "intercept": ("double", "intercept"),
        "slope": ("double", "slope"),
        "std_error_slope": ("double", "Std_Error_slope"),
        "p_value_slope": ("double", "p_value_slope"),
        "std_error_intercept": ("double", "Std_Error_intercept"),
        "p_value_intercept": ("double", "p_value_intercept"),
    },
    "fit_summary": {
        "stream": ("string", "Stream"),
        "depth_loc": ("string", "Depth_Loc"),
        "substrate": ("string", "Substrate"),
        "n_type": ("string", "N_Type"),
        "n": ("bigint", "n"),
    },
    "discharge_daily": {
        "site_no": ("string", "site_no"),
        "date": ("date", "dateTime"),
        "discharge_cfs": ("double", "X_00060_00003"),
    },
    "snow_daily": {
        "site_id": ("int", "site_id"),
        "date": ("date", "date"),
        "snow_water_equivalent": ("double", "snow_water_equivalent"),
    },
    "chemistry": {
        "water_year": ("int", "WaterYear"),
        "site": ("string", "site"),
        "date": ("string", "date"),
        "po4_ugl_dl": ("double", "PO4_ugL_dl"),
        "no3_mgl_dl": ("double", "NO3_mgL_dl"),
        "nh4_mgl_dl": ("double", "NH4_mgL_dl"),
        "doc_mgl_dl": ("double", "DOC_mgL_dl"),
        "temp_c": ("double", "temp_C"),
    },
}

# The converted readings: the raw ones with shore, lake conditions and ammonium in place of ammonia
TABLES["incubation_nh4"] = {k: v for k, v in TABLES["incubation_raw"].items() if k != "nh3_mgn_l"} | {
    "shore": ("string", "Shore"),
    "temp_deg_c": ("double", "Temp_degC"),
    "ph": ("double", "pH"),
    "nh4_mgn_l": ("double", "NH4_mgNL"),
}
TABLES["uptake_rates"] = {
    "inc_month": ("string", "Inc_month"),
    "site": ("string", "Site"),
    "location": ("string", "Location"),
    "depth": ("double", "Depth"),
    "analyte": ("string", "Analyte"),
    "spike_ug_l": ("double", "Spike_µg_L"),
    "mean_spike_conc": ("double", "mean_spike_conc"),
    "volume_lake_water_l": ("double", "Volume_lake_water_L"),
    "type": ("string", "Type"),
    "no2_no3_mgn_l": ("double", "NO2_NO3_mgNL"),
    "nh4_mgn_l": ("double", "NH4_mgNL"),
    "conc_ugn_l": ("double", "conc_ugNL"),
    "ph": ("double", "pH"),
    "weight_g": ("double", "Weight_g"),
    "afdm_g": ("double", "AFDM_g"),
    "real_icu_hrc": ("double", "real_icu_hrc"),
    "delta_conc": ("double", "delta_conc"),
    "delta_conc_hr": ("double", "delta_conc_hr"),
    "water_delta_conc_hr": ("double", "water_delta_conc_hr"),
    "net_delta_conc_hr": ("double", "net_delta_conc_hr"),
}
TABLES["outlier_rules"] = {
    name: ("string" if name in ("site", "inc_month", "type", "analyte") else "double", name)
    for name in ("site", "inc_month", "type", "analyte", "rate_lt", "rate_gt", "spike_eq", "spike_ne")
}

# Other spellings under which a header arrives
HEADER_ALIASES = {"OM_%": ["OM_."], "Spike_µg_L": ["Spike_ug_L"]}


def table_schema(table: str) -> T.StructType:
    """The ``StructType`` of a named table."""
    ddl = ", ".join(f"{name} {kind}" for name, (kind, _) in TABLES[table].items())
    return T.StructType.fromDDL(ddl)
