"""Wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """One row per id row and value column; missing values keep their row."""
    return df.unpivot(ids, values, name, value)
