"""Constants and label lists that results depend on.

They describe the instruments, sites and conventions of the experiments and
are the defaults of the functions that take them as arguments.
"""

# Acid-base speciation of ammonia: pKa = PKA_OFFSET + PKA_SLOPE / (T + KELVIN_OFFSET)
PKA_OFFSET = 0.09018
PKA_SLOPE = 2727.92
KELVIN_OFFSET = 273.15

# Detection limits (mg N / L) and the values put in their place
NH3_DETECTION_LIMIT = 0.002
NH3_BELOW_LIMIT = 0.001
NO3_DETECTION_LIMIT = 0.003
NO3_BELOW_LIMIT = 0.0015
UG_PER_MG = 1000.0

# Incubation time: text used when the clock reading is missing, longest
# accepted reading and the value that replaces longer ones (hours)
DEFAULT_INCUBATION_CLOCK = "06:46:00"
LONGEST_INCUBATION_HOURS = 7 + 41 / 60
CAPPED_INCUBATION_HOURS = 6 + 46 / 60

# Spike baseline patches
UNSPIKED_BASELINE = 0.0
PATCHED_SPIKE = 100.0
PATCHED_BASELINE = 117.5

# Leading rows without an incubation month in the sorted readings
BLANK_HEAD_ROWS = 70

# Shore of a sampling location, by the start of its name
SHORE_PREFIXES = {"E": ["GB", "SH"], "L": ["DI_blank"], "W": ["BW", "SS"]}

# Locations that borrow the water control of another one
BORROWED_CONTROL = {"SH": "GB", "SS": "BW"}

SPIKE_TYPE = "spike"
WATER_TYPE = "water"
SUBSTRATE_TYPES = ["biofilm", "sediment"]
INCUBATION_MONTHS = ["May", "June", "July"]

# Outlier rules: site, month, type, analyte, then the bound that is crossed
OUTLIER_RULES = [
    {"site": "BW0.5m", "inc_month": "July", "type": "biofilm", "analyte": "NH3", "rate_lt": 0.0},
    {"site": "BW0.5m", "inc_month": "July", "type": "biofilm", "analyte": "NO3", "rate_lt": 0.0},
    {"site": "BW0.5m", "inc_month": "July", "type": "sediment", "analyte": "NO3", "rate_lt": 0.0, "spike_ne": 0.0},
    {"site": "BW0.5m", "inc_month": "May", "type": "sediment", "analyte": "NH3", "rate_gt": 200.0},
    {"site": "BW0.5m", "inc_month": "May", "type": "sediment", "analyte": "NO3", "rate_gt": 200.0},
    {"site": "BW10m", "inc_month": "June", "type": "sediment", "analyte": "NO3", "spike_eq": 800.0},
    {"site": "BW3m", "inc_month": "May", "type": "sediment", "analyte": "NO3", "rate_lt": 0.0},
    {"site": "GB0.5m", "inc_month": "May", "type": "biofilm", "analyte": "NO3", "spike_eq": 800.0},
    {"site": "GB3m", "inc_month": "June", "type": "sediment", "analyte": "NO3", "rate_lt": -50.0},
    {"site": "GB3m", "inc_month": "May", "type": "sediment", "analyte": "NO3", "rate_lt": 0.0},
    {"site": "GB10m", "inc_month": "May", "type": "sediment", "analyte": "NO3", "rate_lt": 0.0},
    {"site": "GB10m", "inc_month": "June", "type": "sediment", "analyte": "NO3", "rate_gt": 100.0},
    {"site": "SS3m", "inc_month": "June", "type": "sediment", "analyte": "NO3", "rate_gt": 40.0},
    {"site": "SS3m", "inc_month": "May", "type": "sediment", "analyte": "NO3", "rate_lt": 0.0},
    {"site": "SH3m", "inc_month": "May", "type": "sediment", "analyte": "NO3", "spike_eq": 800.0},
]

# Depth (m) of a site and the zone it lies in; order of site labels in reports
DEPTH_ZONES = {0.5: "INT", 3.0: "NS", 10.0: "SL"}
SITE_ORDER = ["BWINT", "GBINT", "BWNS", "GBNS", "SSNS", "SHNS", "BWSL", "GBSL"]

# Order of the uptake metrics in reports
UPTAKE_METRICS = ["raw_uptake", "weight_corrected", "afdm_corrected"]

# Points of a predicted response curve; half-width of a 95 % interval in SEs
CURVE_POINTS = 100
# Points of a straight trend line
TREND_POINTS = 80
NORMAL_95 = 1.96
SIGNIFICANCE_LEVEL = 0.05

# Incubations left out of the fit catalogue
EXCLUDED_MODELS = [
    "BW0.5m_June_sediment_NO3",
    "BW0.5m_May_sediment_NO3",
    "BW3m_June_sediment_NO3",
    "GB0.5m_July_sediment_NO3",
    "GB0.5m_June_sediment_NO3",
    "GB0.5m_May_biofilm_NH3",
    "GB0.5m_May_biofilm_NO3",
    "GB0.5m_May_sediment_NH3",
    "GB0.5m_May_sediment_NO3",
    "SS3m_May_sediment_NO3",
]

# Site code of a model name and its stream_zone label
SITE_LABELS = {
    "BW0.5m": "BW_INT",
    "BW10m": "BW_SL",
    "BW3m": "BW_NS",
    "GB0.5m": "GB_INT",
    "GB10m": "GB_SL",
    "GB3m": "GB_NS",
    "SH3m": "SH_NS",
    "SS3m": "SS_NS",
}

# Stream gauges: site code, label, catchment area (km2); unit of discharge
GAUGES = {
    "10336730": {"site": "GB", "label": "east", "area_km2": 10.64485},
    "10336660": {"site": "BW", "label": "west", "area_km2": 29.00787},
}
CMS_PER_CFS = 0.0283168

# Snow stations and the period of the series, both ends included
SNOW_STATION_SITES = {615: "GB"}
SNOW_DEFAULT_SITE = "BW"
SERIES_START = "2023-01-01"
SERIES_END = "2023-09-01"
HIGHLIGHT_DATES = ["2023-05-24", "2023-06-26", "2023-07-21"]

# Chemistry: water year, sites left out, position labels and their order
WATER_YEAR = 2023
EXCLUDED_CHEMISTRY_SITES = ["GBL", "BWL"]
SITE_POSITIONS = {
    "SHNS1": "SH(NS)",
    "SHNS2": "SH(NS)",
    "SHNS3": "SH(NS)",
    "SSNS1": "SS(NS)",
    "SSNS2": "SS(NS)",
    "SSNS3": "SS(NS)",
    "GBNS1": "GB(NS)",
    "GBNS2": "GB(NS)",
    "GBNS3": "GB(NS)",
    "BWNS1": "BW(NS)",
    "BWNS2": "BW(NS)",
    "BWNS3": "BW(NS)",
    "GB0.5m": "GB(0.5m)",
    "BW0.5m": "BW(0.5m)",
    "GBO": "GB(Outlet)",
    "BWO": "BW(Outlet)",
}
CHEMISTRY_POSITION_ORDER = [
    "GB(Outlet)", "GB(0.5m)", "GB(NS)",
    "BW(Outlet)", "BW(0.5m)", "BW(NS)",
    "SS(NS)", "SH(NS)",
]
TEMPERATURE_POSITION_ORDER = [
    "SH(NS)", "SS(NS)", "GB(NS)", "BW(NS)",
    "GB(0.5m)", "BW(0.5m)", "GB(Outlet)", "BW(Outlet)",
]
SOLUTES = ["po4_mgl_dl", "no3_mgl_dl", "nh4_mgl_dl", "doc_mgl_dl"]
SOLUTE_LIMITS = {"doc_mgl_dl": 5.0}
DEFAULT_SOLUTE_LIMIT = 0.125

# Month labels of the temperature profile and the months it reports
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct"]
PROFILE_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep"]

# Two-digit years from this one on belong to the 1900s
CENTURY_PIVOT = 69

# Local regression: share of points per neighbourhood, points of the curve
LOESS_SPAN = 0.75
LOESS_POINTS = 80
