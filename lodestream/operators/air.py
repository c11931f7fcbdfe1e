"""Readings of the daily bulletins, as TESTDATA.md defines them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_of(categories: DataFrame) -> tuple[int, int]:
    """The lowest and highest value of the index, from the category table (one row per category)."""
    lo, hi = categories.agg(F.min("aqi_min"), F.max("aqi_max")).first()
    return (0 if lo is None else lo), (500 if hi is None else hi)


def listed(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows whose city stands, character for character, in the reference list."""
    return rows.join(cities.select("city").distinct(), "city", "left_semi")


def readings(rows: DataFrame, cities: DataFrame, scale: tuple[int, int], *more: str) -> DataFrame:
    """Rows that are readings: listed city, a date, and an index within the scale; ``more``: further columns to keep."""
    ok = F.col("board").isNotNull() & F.col("date").isNotNull() & F.col("aqi").between(*scale)
    return listed(rows.where(ok).select("board", "city", "date", "aqi", *more), cities)
