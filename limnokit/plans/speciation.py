"""Raw readings with shore, lake conditions and ammonium concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.text import starts_with_any
from limnokit.operators.joins import attach_group_values
from limnokit.operators.ordered import skip_head


def shore_of(location: Column | str, prefixes: dict[str, list[str]] = fixed.SHORE_PREFIXES) -> Column:
    """Shore label by the start of the location's name, NULL for other names."""
    labels = [F.when(starts_with_any(location, starts), F.lit(shore)) for shore, starts in prefixes.items()]
    return F.coalesce(*labels)


def ammonia_fraction(temp_deg_c: Column | str, ph: Column | str) -> Column:
    """Share of un-ionised ammonia at a temperature and pH."""
    temp = F.col(temp_deg_c) if isinstance(temp_deg_c, str) else temp_deg_c
    acidity = F.col(ph) if isinstance(ph, str) else ph
    pka = F.lit(fixed.PKA_OFFSET) + F.lit(fixed.PKA_SLOPE) / (temp + F.lit(fixed.KELVIN_OFFSET))
    return F.lit(1.0) / (F.pow(F.lit(10.0), pka - acidity) + F.lit(1.0))


def with_ammonium(df: DataFrame, share: str) -> DataFrame:
    """Ammonium from total ammonia, on the ammonia rows only; ``share`` is the ionised part."""
    total = F.when(F.col("analyte") == "NH3", F.col("conc_mgn_l"))
    return df.withColumn("nh4_mgn_l", F.col(share) * total)


def convert_ammonium(raw: DataFrame, lake: DataFrame, skip_rows: int | None = None) -> DataFrame:
    """Readings joined to the lake conditions of their shore and month.

    The lake table is settled like any other small side, so that a table
    without a known size does not cause the readings to be shuffled; its share
    of ammonium is computed there, once a lake row and not once a reading.
    Rows without an incubation month are dropped by their blank label; with
    ``skip_rows`` they are instead dropped by position, as so many rows at
    the head of the table sorted by month and vial, then by all other columns.
    """
    labelled = raw.withColumn("shore", shore_of("location"))
    temp = F.col("temp_deg_c").try_cast("double")
    # Computed per lake row, also for those no reading meets: at absolute zero the quotient is NULL, not an error
    free = ammonia_fraction(F.nullif(temp, F.lit(-fixed.KELVIN_OFFSET)), F.col("ph").try_cast("double"))
    conditions = lake.select("shore", "inc_month", "temp_deg_c", "ph", (F.lit(1.0) - free).alias("__ionised"))
    joined = attach_group_values(labelled, conditions, ["shore", "inc_month"], "lake")
    if skip_rows is None:
        kept = joined.filter((F.col("inc_month") != "") | F.col("inc_month").isNull())
    else:
        # the other columns break ties, so that equal keys spread and the same rows go each time
        first = ["inc_month", "vial_num"]
        order = [*first, *sorted(c for c in joined.columns if c not in [*first, "__ionised"])]
        kept = skip_head(joined, order, skip_rows)
    return with_ammonium(kept, "__ionised").drop("nh3_mgn_l", "__ionised")
