"""Clock texts and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit import fixed_values as fixed
from limnokit.functions.text import _col

# An H:MM reading at the start of the text; month/day/two-digit year
CLOCK_PATTERN = r"^\s*(2[0-3]|[01]?\d):([0-5]?\d)"
SHORT_DATE_PATTERN = r"^\s*(\d{1,2})/(\d{1,2})/(\d{1,2})"


def clock_match(c: Column | str) -> Column:
    """The ``H:MM`` at the start of the text; empty when it is not a clock reading."""
    return F.ltrim(F.regexp_extract(_col(c), CLOCK_PATTERN, 0))


def normal_clock(c: Column | str) -> Column:
    """``H:MM`` as ``HH:MM:00``, NULL when the text is not a clock reading."""
    found = clock_match(c)
    hour, minute = F.split_part(found, F.lit(":"), F.lit(1)), F.split_part(found, F.lit(":"), F.lit(2))
    return F.when(found != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":00")))


def clock_hours(c: Column | str) -> Column:
    """Decimal hours of an ``H:MM`` or ``HH:MM:SS`` text, from its hour and minute."""
    parts = [F.split_part(_col(c), F.lit(":"), F.lit(i)).try_cast("double") for i in (1, 2)]
    return parts[0] + parts[1] / F.lit(60.0)


def split_hours(c: Column | str) -> Column:
    """First part plus second part / 60 of any ``:``-separated text."""
    return clock_hours(c)


def with_incubation_hours(
    df: DataFrame,
    clock: str,
    name: str,
    default_clock: str = fixed.DEFAULT_INCUBATION_CLOCK,
    longest: float = fixed.LONGEST_INCUBATION_HOURS,
    replacement: float = fixed.CAPPED_INCUBATION_HOURS,
) -> DataFrame:
    """Hours of incubation: default when missing, replaced when too long.

    Built in steps, so that each text is matched once per row. What was matched
    has one colon; an empty match has no hours.
    """
    hour, minute = (F.substring_index("__clock", ":", i).try_cast("double") for i in (1, -1))
    hours = F.coalesce(hour + minute / F.lit(60.0), clock_hours(F.lit(default_clock)))
    capped = F.when(F.col("__hours") > F.lit(longest), F.lit(replacement)).otherwise(F.col("__hours"))
    staged = df.withColumn("__clock", clock_match(clock)).withColumn("__hours", hours)
    return staged.withColumn(name, capped).drop("__clock", "__hours")


def short_date(c: Column | str, pivot: int = fixed.CENTURY_PIVOT) -> Column:
    """``month/day/yy`` text as a date; years from ``pivot`` on are 19xx.

    Characters after the two year digits are ignored, so ``5/24/2023`` reads
    as year 20, just as the format says. Impossible dates give NULL.
    """
    text = _col(c)
    year = F.regexp_extract(text, SHORT_DATE_PATTERN, 3).try_cast("int")
    full_year = year + F.when(year >= F.lit(pivot), F.lit(1900)).otherwise(F.lit(2000))
    month, day = (F.regexp_extract(text, SHORT_DATE_PATTERN, i) for i in (1, 2))
    iso = F.concat_ws("-", full_year.cast("string"), month, day)
    return F.when(year.isNotNull(), F.try_to_date(iso, "yyyy-M-d"))


def month_label(date: Column | str) -> Column:
    """Three-letter month name of a date."""
    return F.date_format(_col(date), "MMM")
