"""Bulletins as a stream: rows that arrive in files, repeated rows dropped within the watermark, running totals by day.

An extension; the batch operators don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.schemas import ARRIVING


def arriving(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Parquet files of bulletin rows as they land, a bounded number a trigger."""
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files).parquet(path)


def first_of_day(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """One row per board, city and day within the watermark of arrival."""
    timed = rows.withColumn("at", F.col("ingested_at").cast("timestamp"))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["board", "city", "date"])


def daily_totals(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """Readings and their sum per board and day of arrival, final once the watermark has passed."""
    timed = rows.where("aqi BETWEEN 0 AND 500").withColumn("at", F.col("ingested_at").cast("timestamp"))
    day = F.window("at", "1 day")
    g = timed.withWatermark("at", late).groupBy(day, "board").agg(F.count("aqi").alias("n"), F.sum("aqi").alias("total"))
    return g.select(F.col("window.start").cast("date").alias("day"), "board", "n", "total")
