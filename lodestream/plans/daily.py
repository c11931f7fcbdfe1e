"""Queries over the daily bulletins: trailing totals, implausible readings, regular grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import air, series
from lodestream.runtime import durable, table

KEYS = ("board", "city")


def _readings(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int]]:
    scale = air.scale_of(table(spark, d, "aqi_categories"))
    return air.readings(table(spark, d, "city_aqi_daily"), table(spark, d, "city_reference"), scale), scale


def trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the last 7 and 30 days of every series and day."""
    rows, _ = _readings(spark, d)
    return series.trailing_totals(rows, KEYS, "date", "aqi", (7, 30))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = trailing(spark, d)
    rise = F.expr("n_7 >= 3 AND n_30 >= 10 AND 5 * sum_7 * n_30 >= 7 * sum_30 * n_7")
    return t.where(rise).select("board", "city", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p3_trailing(spark: SparkSession, d: str) -> DataFrame:
    return _p3_columns(trailing(spark, d))


def _p3_columns(t: DataFrame) -> DataFrame:
    return t.select("board", "city", F.date_format("day", "yyyy-MM-dd").alias("day"), "sum_7", F.col("n_7").cast("long"), "sum_30", F.col("n_30").cast("long"), F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"))


def p3_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The totals from stored trees: built from the rows that came within three days, then corrected by all later rows."""
    scale = air.scale_of(table(spark, d, "aqi_categories"))
    rows = air.readings(table(spark, d, "city_aqi_daily"), table(spark, d, "city_reference"), scale, "ingested_at")
    late = F.coalesce(F.datediff("ingested_at", "date") > 3, F.lit(False))
    trees = durable(series.segment_trees(rows.where(~late), KEYS, "date", "aqi"))
    # The highest of a day counts, whenever it came.
    touched = rows.where(late).groupBy(*KEYS, "date").agg(F.max("aqi").alias("aqi"))
    before = rows.where(~late).join(touched.select(*KEYS, "date"), [*KEYS, "date"], "left_semi").select(*KEYS, "date", "aqi")
    changed = durable(series.correct_trees(trees, touched.unionByName(before), KEYS, "date", "aqi"))
    return _p3_columns(series.totals_of_trees(series.with_corrections(trees, changed, KEYS), KEYS, (7, 30)))


def p6_fill_error(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth reading (by a hash of series and day) is hidden and filled again: mean absolute error by method over the
    hidden cells that are supported, beside the mean of the series and its last value before."""
    rows, scale = _readings(spark, d)
    daily = durable(rows.groupBy(*KEYS, "date").agg(F.max("aqi").alias("aqi")))
    hidden = F.pmod(F.xxhash64(*KEYS, "date"), F.lit(10)) == 0
    shown = daily.where(~hidden)
    grid = series.regular_grid(shown, KEYS, "date", "aqi", ("board",), *scale, shared=durable).where("status = 'filled'").select(*KEYS, F.col("day").alias("date"), F.col("value").alias("als"))
    cells = daily.where(hidden).join(grid, [*KEYS, "date"])
    means = shown.groupBy(*KEYS).agg(F.avg("aqi").alias("mean"))
    before = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    last = daily.withColumn("last", F.last(F.when(~hidden, F.col("aqi")), ignorenulls=True).over(before)).select(*KEYS, "date", "last")
    each = cells.join(means, list(KEYS)).join(last, [*KEYS, "date"])
    error = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("aqi"))), 3)
    return each.agg(F.count(F.lit(1)).alias("cells"), error("als").alias("als"), error("mean").alias("mean"), error("last").alias("last"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scale = air.scale_of(table(spark, d, "aqi_categories"))
    rows = table(spark, d, "city_aqi_daily").select("row_id", "board", "city", "date", "aqi")
    rows = air.listed(rows, table(spark, d, "city_reference"))
    return series.flag_rows(rows, "row_id", KEYS, "date", "aqi", *scale).select("row_id")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    rows, scale = _readings(spark, d)
    return series.regular_grid(rows, KEYS, "date", "aqi", ("board",), *scale, shared=durable)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grid(spark, d).where("status <> 'observed'").select("board", "city", F.date_format("day", "yyyy-MM-dd").alias("day"))


_READINGS = """readings AS (
  SELECT r.board, r.city, CAST(r.date AS DATE) AS day, max(r.aqi) AS aqi
  FROM city_aqi_daily r
  WHERE r.board IS NOT NULL AND r.date IS NOT NULL
    AND r.aqi BETWEEN (SELECT min(aqi_min) FROM aqi_categories) AND (SELECT max(aqi_max) FROM aqi_categories)
    AND r.city IN (SELECT city FROM city_reference)
  GROUP BY ALL
), spans AS (
  SELECT board, city, min(day) AS d0, max(day) AS d1 FROM readings GROUP BY ALL
), grid AS (
  SELECT board, city, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM spans
), cells AS (
  SELECT g.board, g.city, g.day, r.aqi FROM grid g LEFT JOIN readings r USING (board, city, day)
), totals AS (
  SELECT board, city, day, aqi,
    coalesce(sum(aqi) OVER w7, 0) AS sum_7, count(aqi) OVER w7 AS n_7,
    coalesce(sum(aqi) OVER w30, 0) AS sum_30, count(aqi) OVER w30 AS n_30
  FROM cells
  WINDOW w7 AS (PARTITION BY board, city ORDER BY day ROWS 6 PRECEDING),
         w30 AS (PARTITION BY board, city ORDER BY day ROWS 29 PRECEDING)
)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_READINGS} SELECT board, city, strftime(day, '%Y-%m-%d') AS day FROM totals WHERE n_7 >= 3 AND n_30 >= 10 AND 5 * sum_7 * n_30 >= 7 * sum_30 * n_7",
    "p3_trailing": f"WITH {_READINGS} SELECT board, city, strftime(day, '%Y-%m-%d') AS day, CAST(sum_7 AS BIGINT) AS sum_7, n_7, CAST(sum_30 AS BIGINT) AS sum_30, n_30, round(CAST(sum_7 AS DOUBLE) / nullif(n_7, 0), 6) AS avg_7, round(CAST(sum_30 AS DOUBLE) / nullif(n_30, 0), 6) AS avg_30 FROM totals",
    "p6_found": f"WITH {_READINGS} SELECT board, city, strftime(day, '%Y-%m-%d') AS day FROM cells WHERE aqi IS NULL",
}

SQL["p3_corrected"] = SQL["p3_trailing"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_trailing": p3_trailing,
    "p3_corrected": p3_corrected,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_grid": p6_grid,
    "p6_fill_error": p6_fill_error,
}
