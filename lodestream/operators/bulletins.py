"""The monitoring table: bulletins to rows, canonical spellings, one row per city and day, gaps and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.schemas import BANDS

_NAMES = "|".join(name for name, *_ in BANDS)
# One record of a bulletin and its header.
RECORD = rf"(?m)^\d+\n[^\n]+\n(?:{_NAMES})\n(?:\d+\n)?[^\n\d][^\n]*(?:\n\d+\s*/\s*\d+)?$"
PARTS = rf"^\d+\n([^\n]+)\n({_NAMES})\n(?:(\d+)\n)?([^\n\d][^\n]*)(?:\n(\d+)\s*/\s*(\d+))?$"
HEADER = r"Air Quality Index on (\w{3} \d{1,2}, \d{4})"


def parse_bulletins(files: DataFrame, text: str = "text", header: str = HEADER, stem: str | None = None) -> DataFrame:
    """Rows of bulletin texts, with the other columns of ``files``. A text without a header date gives none, nor does one
    whose date differs from the date in ``stem`` (yyyyMMdd), where given. A record is cut out whole before its parts are read, so
    missing parts (value, stations) stay aligned."""
    clean = F.regexp_replace(F.col(text), r"[ \t]+\n", "\n")
    day = F.try_to_date(F.regexp_extract(clean, header, 1), "MMM d, yyyy")
    dated = files.withColumn("__ls_text", clean).withColumn("date", day).where("date IS NOT NULL")
    if stem:
        dated = dated.where(F.date_format("date", "yyyyMMdd") == F.col(stem))
    each = dated.withColumn("__ls_r", F.explode(F.regexp_extract_all("__ls_text", F.lit(RECORD), F.lit(0))))
    part = lambda k: F.regexp_extract("__ls_r", PARTS, k)
    number = lambda k: F.nullif(part(k), F.lit("")).try_cast("int")
    rest = [c for c in files.columns if c not in (text, "date")]
    return each.select(*rest, "date", F.trim(part(1)).alias("city"), number(3).alias("aqi"), part(2).alias("aqi_category"), F.trim(part(4)).alias("prominent_pollutant"), number(5).alias("stations_reporting"), number(6).alias("stations_total"))


def category_of(aqi: Column) -> Column:
    """The band of a value: the first upper bound at or above it; beyond the scale the last band; null for null."""
    out = F.when(aqi.isNotNull(), BANDS[-1][0])
    for name, _, _, high in reversed(BANDS[:-1]):
        out = F.when(aqi <= high, name).otherwise(out)
    return out


def consistency(rows: DataFrame) -> DataFrame:
    """One row: rows, rows whose category isn't that of the value, rows with a category only, distinct cities."""
    wrong = F.col("aqi").isNotNull() & (category_of(F.col("aqi")) != F.col("aqi_category"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("mismatched"), F.count_if(F.col("aqi").isNull() & F.col("aqi_category").isNotNull()).alias("category_only"), F.countDistinct("city").alias("cities"))


def canonical_spelling(rows: DataFrame, city: str = "city") -> DataFrame:
    """``lower_city``, ``spelling``: of spellings that differ in case only the most frequent; of equals the last in order."""
    n = rows.where(F.col(city).isNotNull()).groupBy(city).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.lower(city).alias("lower_city")).agg(F.max_by(city, F.struct("n", city)).alias("spelling"))


def city_days(rows: DataFrame, tie: str) -> DataFrame:
    """The loaded table: canonical spellings, one row per city and day: the highest value, nulls last, then the lowest ``tie``.

    A grouped maximum, so the rows of a hot city are reduced before they are shuffled; no window over a city.
    """
    kept = ["aqi", "aqi_category", "prominent_pollutant", "stations_reporting", "stations_total"]
    spelt = rows.join(canonical_spelling(rows), F.lower("city") == F.col("lower_city"))
    best = F.max_by(F.struct(*kept), F.struct(F.col("aqi").isNotNull(), F.col("aqi"), -F.col(tie)))
    one = spelt.where("date IS NOT NULL").groupBy(F.col("spelling").alias("city"), "date").agg(best.alias("b"))
    return one.select("city", "date", *[F.col(f"b.{c}") for c in kept])


def load_stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("city").alias("cities"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_if(F.col("aqi").isNull()).alias("null_aqi"))


def gap_report(table: DataFrame, cities: DataFrame) -> DataFrame:
    """Per listed city: days in the table's range, reported days, their share, days with a category only, mean station
    coverage, longest gap (null without one).

    No grid of city and day is made: gaps are the distances between successive reported days and to the ends
    of the range. A listed city without a row has one gap, the whole range.
    """
    span = table.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    reported = F.col("aqi_category").isNotNull()
    w = Window.partitionBy("city").orderBy("date")
    seen = table.join(cities.select("city").distinct(), "city", "left_semi")
    days = seen.where(reported).withColumn("last", F.lag("date").over(w))
    share = F.col("stations_reporting").cast("double") / F.nullif(F.col("stations_total"), F.lit(0))
    gaps = days.groupBy("city").agg(F.max(F.datediff("date", "last") - 1).alias("inner"), F.min("date").alias("a"), F.max("date").alias("b"))
    facts = seen.groupBy("city").agg(F.count("aqi_category").alias("days_reported"), F.count_if(reported & F.col("aqi").isNull()).alias("days_category_only"), F.avg(share).alias("coverage"))
    all_ = cities.select("city").where("city IS NOT NULL").distinct().join(facts, "city", "left").join(gaps, "city", "left").crossJoin(span)
    total = F.datediff("d1", "d0") + 1
    longest = F.greatest(F.coalesce("inner", F.lit(0)), F.datediff("a", "d0"), F.datediff("d1", "b"))
    n = F.coalesce("days_reported", F.lit(0))
    return all_.select(
        "city", total.cast("long").alias("days_in_range"), n.cast("long").alias("days_reported"),
        F.round(F.lit(100.0) * n / total, 1).cast("double").alias("pct_days_reported"),
        F.coalesce("days_category_only", F.lit(0)).cast("long").alias("days_category_only"),
        F.round(F.lit(100.0) * F.col("coverage"), 1).alias("mean_station_coverage_pct"),
        F.nullif(F.when(F.col("a").isNull(), total).otherwise(longest), F.lit(0)).cast("long").alias("longest_gap_days"),
    )


def coverage(table: DataFrame, asked: DataFrame, low: float = 70.0) -> DataFrame:
    """Per row of ``asked`` (city, d0, d1): days in range, reported days, their share, station coverage, whether it is low."""
    t = table.select(F.col("city").alias("t_city"), "date", (F.col("stations_reporting").cast("double") / F.nullif(F.col("stations_total"), F.lit(0))).alias("share"))
    j = asked.join(t, (F.col("city") == F.col("t_city")) & F.col("date").between(F.col("d0"), F.col("d1")), "left")
    total = F.datediff("d1", "d0") + 1
    out = j.groupBy("city", "d0", "d1").agg(F.count("date").alias("days_reported"), F.round(F.avg("share") * 100, 1).alias("station_coverage_pct"))
    pct = F.round(F.lit(100.0) * F.col("days_reported") / total, 1).cast("double")
    return out.select("city", "d0", "d1", total.cast("long").alias("days_in_range"), "days_reported", pct.alias("pct_days_reported"), "station_coverage_pct", (pct < low).alias("low_coverage"))


def station_city_days(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """The view over station readings: means, highest index and number of stations per city and day."""
    j = readings.join(stations.select("station_id", "city"), "station_id")
    return j.groupBy("city", "date").agg(F.avg("pm25").alias("pm25"), F.avg("pm10").alias("pm10"), F.max("aqi").alias("max_station_aqi"), F.count(F.lit(1)).alias("n_stations"))


def missing_days(landed: DataFrame, first: str, last: str) -> DataFrame:
    """Days of a range for which no bulletin has landed."""
    days = landed.sparkSession.sql("SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE))) AS day", args={"a": first, "b": last})
    return days.join(landed.select("day").distinct(), "day", "left_anti")


def ask(spark: SparkSession, cities: Sequence[str], d0: str, d1: str) -> DataFrame:
    """Cities and one range as input of ``coverage``, bound as parameters."""
    if not cities:
        return spark.sql("SELECT CAST(NULL AS STRING) AS city, CAST(:a AS DATE) AS d0, CAST(:b AS DATE) AS d1 LIMIT 0", args={"a": d0, "b": d1})
    listed = F.array(*map(F.lit, cities))
    return spark.sql("SELECT explode(:c) AS city, CAST(:a AS DATE) AS d0, CAST(:b AS DATE) AS d1", args={"c": listed, "a": d0, "b": d1})
