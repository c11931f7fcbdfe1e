"""Queries over the loaded monitoring table: loading, reports, and the ad-hoc questions the table is asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import bulletins as B
from lodestream.plans import guard
from lodestream.runtime import table


def loaded(spark: SparkSession, d: str) -> DataFrame:
    return B.city_days(table(spark, d, "city_aqi_daily"), "row_id")


def reference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_reference")


def views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations of ad-hoc SQL; station tables stand empty."""
    from lodestream.schemas import READINGS, STATIONS

    stations, readings = spark.createDataFrame([], STATIONS), spark.createDataFrame([], READINGS)
    return {"city_aqi_daily": loaded(spark, d), "aqi_categories": table(spark, d, "aqi_categories"), "stations": stations, "readings_daily": readings, "city_daily": B.station_city_days(readings, stations)}


#: Busy city, second city and period of the example questions.
ONE, TWO, FIRST, LAST = "Khidhinagar", "Jatovali", "2024-01-01", "2024-12-31"

# The loaded table in SQL.
LOADED = """spelt AS (
  SELECT lower(city) AS lc, city, count(*) AS n FROM city_aqi_daily WHERE city IS NOT NULL GROUP BY ALL
), best AS (
  SELECT lc, city AS spelling FROM spelt QUALIFY row_number() OVER (PARTITION BY lc ORDER BY n DESC, city DESC) = 1
), t AS (
  SELECT spelling AS city, date, aqi, aqi_category, prominent_pollutant, stations_reporting, stations_total
  FROM city_aqi_daily r JOIN best b ON lower(r.city) = b.lc WHERE r.date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY spelling, date ORDER BY aqi DESC NULLS LAST, row_id) = 1
)"""


def canonical_spelling(s: SparkSession, d: str) -> DataFrame:
    return B.canonical_spelling(table(s, d, "city_aqi_daily"))


def load_stats(s: SparkSession, d: str) -> DataFrame:
    return B.load_stats(loaded(s, d))


def band_lookup(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "city_aqi_daily")
    return t.select("row_id", "aqi", B.category_of(F.col("aqi")).alias("band"))


def band_range_join(s: SparkSession, d: str) -> DataFrame:
    """The same by a range join with the category table (six rows)."""
    t, c = table(s, d, "city_aqi_daily"), table(s, d, "aqi_categories")
    j = t.join(c.select(F.col("aqi_category").alias("band"), "aqi_min", "aqi_max"), F.col("aqi").between(F.col("aqi_min"), F.col("aqi_max")))
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band") == F.col("aqi_category")).alias("agreeing"))


def band_mismatch(s: SparkSession, d: str) -> DataFrame:
    return B.consistency(table(s, d, "city_aqi_daily"))


def gap_report(s: SparkSession, d: str) -> DataFrame:
    return B.gap_report(loaded(s, d), reference(s, d))


def coverage_by_city_range(s: SparkSession, d: str) -> DataFrame:
    asked = reference(s, d).select("city", F.lit(FIRST).cast("date").alias("d0"), F.lit(LAST).cast("date").alias("d1"))
    return B.coverage(loaded(s, d), asked)


def landing_gaps(s: SparkSession, d: str) -> DataFrame:
    return B.missing_days(table(s, d, "city_aqi_daily").select(F.col("date").alias("day")), FIRST, LAST)


def live_facts(s: SparkSession, d: str) -> DataFrame:
    return loaded(s, d).orderBy(F.desc("date"), "city").limit(3).select("city", "date", "aqi", "aqi_category")


def avg_with_day_count(s: SparkSession, d: str) -> DataFrame:
    t = loaded(s, d).where(F.col("date").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))
    return t.groupBy("city").agg(F.round(F.avg("aqi"), 1).alias("avg_aqi"), F.count("aqi").alias("days_with_value"))


def severe_days(s: SparkSession, d: str) -> DataFrame:
    return loaded(s, d).where("aqi_category = 'Severe'").groupBy("city").agg(F.count(F.lit(1)).alias("severe_days"))


def poor_or_worse_days(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "aqi_categories").where("severity_rank >= 4")
    return loaded(s, d).join(c, "aqi_category").groupBy("city").agg(F.count(F.lit(1)).alias("days"))


def worst_day_top1(s: SparkSession, d: str) -> DataFrame:
    t = loaded(s, d).where("aqi IS NOT NULL AND aqi BETWEEN 0 AND 500")
    best = t.groupBy("city").agg(F.max_by(F.struct("date", "aqi", "prominent_pollutant"), F.struct("aqi", -F.unix_date("date"))).alias("b"))
    return best.select("city", "b.*")


def monthly_average(s: SparkSession, d: str) -> DataFrame:
    return loaded(s, d).groupBy("city", F.date_format("date", "yyyy-MM").alias("month")).agg(F.round(F.avg("aqi"), 1).alias("avg_aqi"), F.count("aqi").alias("days"))


def compare_two_cities(s: SparkSession, d: str) -> DataFrame:
    return loaded(s, d).where(F.col("city").isin(ONE, TWO)).groupBy("city").agg(F.round(F.avg("aqi"), 1).alias("avg_aqi"), F.count("aqi").alias("days"))


def share_of_days_pollutant(s: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("prominent_pollutant").like("%PM10%"))
    return loaded(s, d).groupBy("city").agg(F.round(F.lit(100.0).cast("double") * n / F.count(F.lit(1)), 1).alias("pct_days_pm10"))


def rank_over_city(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("city").orderBy(F.desc_nulls_last("aqi"))
    return loaded(s, d).select("city", "date", "aqi", F.rank().over(w).cast("long").alias("r"))


def group_by_all_trunc(s: SparkSession, d: str) -> DataFrame:
    return loaded(s, d).groupBy("city", F.trunc("date", "month").alias("m")).agg(F.round(F.avg("aqi"), 6).alias("avg_aqi"))


def case_label(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("aqi") > 300, "bad").otherwise("ok")
    return loaded(s, d).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def guarded_sql(s: SparkSession, d: str) -> DataFrame:
    """SQL text through the guard: a CTE, a join, a grouped maximum, a limit above the cap."""
    sql = """WITH w AS (SELECT * FROM city_aqi_daily WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31')
      SELECT aqi_category, max(aqi) AS worst, count(*) AS days FROM w JOIN aqi_categories USING (aqi_category)
      WHERE severity_rank >= 3 GROUP BY aqi_category ORDER BY worst DESC LIMIT 5000"""
    return guard.guarded(s, sql, views(s, d))


def station_city_daily_view(s: SparkSession, d: str) -> DataFrame:
    """The station view over line items as readings and suppliers as stations."""
    li, su = table(s, d, "lineitem"), table(s, d, "supplier")
    readings = li.select(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("pm25"), F.col("l_discount").alias("pm10"), F.col("l_linenumber").alias("aqi"))
    stations = su.select(F.col("s_suppkey").alias("station_id"), F.concat(F.lit("N"), "s_nationkey").alias("city"))
    v = B.station_city_days(readings, stations)
    return v.select("city", "date", F.round("pm25", 6).alias("pm25"), F.round("pm10", 6).alias("pm10"), "max_station_aqi", "n_stations")


_Y = f"date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
SQL: dict[str, str] = {
    "canonical_spelling": f"WITH {LOADED} SELECT lc AS lower_city, spelling FROM best",
    "city_day_dedupe": f"WITH {LOADED} SELECT * FROM t",
    "load_stats": f"WITH {LOADED} SELECT count(*) AS n_rows, count(DISTINCT city) AS cities, min(date) AS first_day, max(date) AS last_day, count(*) FILTER (WHERE aqi IS NULL) AS null_aqi FROM t",
    "band_lookup": "SELECT row_id, aqi, CASE WHEN aqi IS NULL THEN NULL WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Satisfactory' WHEN aqi <= 200 THEN 'Moderate' WHEN aqi <= 300 THEN 'Poor' WHEN aqi <= 400 THEN 'Very Poor' ELSE 'Severe' END AS band FROM city_aqi_daily",
    "band_range_join": "SELECT c.aqi_category AS band, count(*) AS n, count(*) FILTER (WHERE c.aqi_category = r.aqi_category) AS agreeing FROM city_aqi_daily r JOIN aqi_categories c ON r.aqi BETWEEN c.aqi_min AND c.aqi_max GROUP BY 1",
    "band_mismatch": "WITH b AS (SELECT *, CASE WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Satisfactory' WHEN aqi <= 200 THEN 'Moderate' WHEN aqi <= 300 THEN 'Poor' WHEN aqi <= 400 THEN 'Very Poor' WHEN aqi IS NOT NULL THEN 'Severe' END AS band FROM city_aqi_daily) SELECT count(*) AS n_rows, count(*) FILTER (WHERE band <> aqi_category) AS mismatched, count(*) FILTER (WHERE aqi IS NULL AND aqi_category IS NOT NULL) AS category_only, count(DISTINCT city) AS cities FROM b",
    "gap_report": f"""WITH {LOADED}, days AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(date) AS d0, max(date) AS d1 FROM t)),
      j AS (SELECT c.city, g.date, t.aqi, t.aqi_category, t.stations_reporting, t.stations_total FROM city_reference c CROSS JOIN days g LEFT JOIN t ON t.city = c.city AND t.date = g.date),
      runs AS (SELECT city, aqi_category IS NULL AS missing, row_number() OVER (PARTITION BY city ORDER BY date) - row_number() OVER (PARTITION BY city, aqi_category IS NULL ORDER BY date) AS g FROM j),
      longest AS (SELECT city, max(n) AS n FROM (SELECT city, g, count(*) AS n FROM runs WHERE missing GROUP BY ALL) GROUP BY city)
      SELECT j.city, count(*) AS days_in_range, count(aqi_category) AS days_reported, CAST(round(100.0 * count(aqi_category) / count(*), 1) AS DOUBLE) AS pct_days_reported,
        count(*) FILTER (WHERE aqi_category IS NOT NULL AND aqi IS NULL) AS days_category_only, round(100.0 * avg(CAST(stations_reporting AS DOUBLE) / nullif(stations_total, 0)), 1) AS mean_station_coverage_pct, any_value(l.n) AS longest_gap_days
      FROM j LEFT JOIN longest l ON l.city = j.city GROUP BY j.city""",
    "coverage_by_city_range": f"""WITH {LOADED} SELECT c.city, DATE '{FIRST}' AS d0, DATE '{LAST}' AS d1, CAST(date_diff('day', DATE '{FIRST}', DATE '{LAST}') + 1 AS BIGINT) AS days_in_range, count(t.date) AS days_reported,
      CAST(round(100.0 * count(t.date) / (date_diff('day', DATE '{FIRST}', DATE '{LAST}') + 1), 1) AS DOUBLE) AS pct_days_reported, round(avg(CAST(stations_reporting AS DOUBLE) / nullif(stations_total, 0)) * 100, 1) AS station_coverage_pct,
      round(100.0 * count(t.date) / (date_diff('day', DATE '{FIRST}', DATE '{LAST}') + 1), 1) < 70 AS low_coverage
      FROM city_reference c LEFT JOIN t ON t.city = c.city AND t.{_Y} GROUP BY c.city""",
    "landing_gaps": f"SELECT day FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day) WHERE day NOT IN (SELECT date FROM city_aqi_daily WHERE date IS NOT NULL)",
    "live_facts": f"WITH {LOADED} SELECT city, date, aqi, aqi_category FROM t ORDER BY date DESC, city LIMIT 3",
    "avg_with_day_count": f"WITH {LOADED} SELECT city, round(avg(aqi), 1) AS avg_aqi, count(aqi) AS days_with_value FROM t WHERE {_Y} GROUP BY city",
    "severe_days": f"WITH {LOADED} SELECT city, count(*) AS severe_days FROM t WHERE aqi_category = 'Severe' GROUP BY city",
    "poor_or_worse_days": f"WITH {LOADED} SELECT city, count(*) AS days FROM t JOIN aqi_categories USING (aqi_category) WHERE severity_rank >= 4 GROUP BY city",
    "worst_day_top1": f"WITH {LOADED} SELECT city, date, aqi, prominent_pollutant FROM t WHERE aqi BETWEEN 0 AND 500 QUALIFY row_number() OVER (PARTITION BY city ORDER BY aqi DESC, date) = 1",
    "monthly_average": f"WITH {LOADED} SELECT city, strftime(date, '%Y-%m') AS month, round(avg(aqi), 1) AS avg_aqi, count(aqi) AS days FROM t GROUP BY ALL",
    "compare_two_cities": f"WITH {LOADED} SELECT city, round(avg(aqi), 1) AS avg_aqi, count(aqi) AS days FROM t WHERE city IN ('{ONE}', '{TWO}') GROUP BY city",
    "share_of_days_pollutant": f"WITH {LOADED} SELECT city, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE prominent_pollutant LIKE '%PM10%') / count(*), 1) AS pct_days_pm10 FROM t GROUP BY city",
    "rank_over_city": f"WITH {LOADED} SELECT city, date, aqi, rank() OVER (PARTITION BY city ORDER BY aqi DESC NULLS LAST) AS r FROM t",
    "group_by_all_trunc": f"WITH {LOADED} SELECT city, CAST(date_trunc('month', date) AS DATE) AS m, round(avg(aqi), 6) AS avg_aqi FROM t GROUP BY ALL",
    "case_label": f"WITH {LOADED} SELECT CASE WHEN aqi > 300 THEN 'bad' ELSE 'ok' END AS label, count(*) AS n FROM t GROUP BY 1",
    "guarded_sql": f"WITH {LOADED} SELECT aqi_category, max(aqi) AS worst, count(*) AS days FROM t JOIN aqi_categories USING (aqi_category) WHERE {_Y} AND severity_rank >= 3 GROUP BY aqi_category",
    "station_city_daily_view": "SELECT concat('N', s_nationkey) AS city, CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS pm25, round(avg(l_discount), 6) AS pm10, max(l_linenumber) AS max_station_aqi, count(*) AS n_stations FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        canonical_spelling, load_stats, band_lookup, band_range_join, band_mismatch, gap_report, coverage_by_city_range, landing_gaps, live_facts,
        avg_with_day_count, severe_days, poor_or_worse_days, worst_day_top1, monthly_average, compare_two_cities, share_of_days_pollutant,
        rank_over_city, group_by_all_trunc, case_label, guarded_sql, station_city_daily_view,
    )
} | {"city_day_dedupe": loaded}
