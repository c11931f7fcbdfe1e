import datetime as dt

import pytest

from lodestream.operators import bulletins as B

D = dt.date
TABLE = "city string, date date, aqi int, aqi_category string, prominent_pollutant string, stations_reporting int, stations_total int"


@pytest.fixture(scope="module")
def aq(spark):
    rows = [("Kanpur", D(2024, 11, d), 150 + 30 * d, "Severe" if d > 8 else "Poor", "PM2.5", 3, 4) for d in range(1, 11) if d != 5] + [("Delhi", D(2024, 11, 15), 396, "Very Poor", "PM10", 38, 39)]
    return spark.createDataFrame(rows, TABLE)


def test_parse_bulletin(spark):
    text = "Air Quality Index on Nov 5, 2024  \nS.No\n1\nKanpur\nSevere\n420\nPM2.5\n3/4\n2\nDelhi\nVery Poor\nPM10, O3\n38 / 39\n3\nPune\nGood\n41\nO3\n"
    df = spark.createDataFrame([("20241105", text), ("20241106", text), ("x", "no header\n1\nA\nGood\n3\nO3"), ("y", None)], "stem string, text string")
    got = B.parse_bulletins(df, stem="stem").orderBy("city").collect()
    assert [(r.city, r.aqi, r.aqi_category, r.prominent_pollutant, r.stations_reporting, r.stations_total) for r in got] == [("Delhi", None, "Very Poor", "PM10, O3", 38, 39), ("Kanpur", 420, "Severe", "PM2.5", 3, 4), ("Pune", 41, "Good", "O3", None, None)]
    assert {r.date for r in got} == {D(2024, 11, 5)}


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0, 50, 51, 100, 101, 300, 301, 400, 401, 999, None)], "aqi int")
    assert [r.c for r in df.select(B.category_of(df.aqi).alias("c")).collect()] == ["Good", "Good", "Satisfactory", "Satisfactory", "Moderate", "Poor", "Very Poor", "Very Poor", "Severe", "Severe", None]


def test_city_days(spark):
    rows = [(1, "Delhi", D(2024, 1, 1), None), (2, "delhi", D(2024, 1, 1), 90), (3, "Delhi", D(2024, 1, 1), 90), (4, "Delhi", D(2024, 1, 2), None), (5, None, D(2024, 1, 2), 5), (6, "Delhi", None, 5)]
    df = spark.createDataFrame([(i, c, d, a, f"cat{i}", "p", 1, 2) for i, c, d, a in rows], "row_id long, city string, date date, aqi int, aqi_category string, prominent_pollutant string, stations_reporting int, stations_total int")
    assert [(r.city, r.date.day, r.aqi, r.aqi_category) for r in B.city_days(df, "row_id").orderBy("date").collect()] == [("Delhi", 1, 90, "cat2"), ("Delhi", 2, None, "cat4")]


def test_gaps_and_coverage(spark, aq):
    cities = spark.createDataFrame([("Kanpur",), ("Delhi",), ("Nowhere",), ("Kanpur",)], "city string")
    g = {r.city: r for r in B.gap_report(aq, cities).collect()}
    assert (g["Kanpur"].days_in_range, g["Kanpur"].days_reported, g["Kanpur"].longest_gap_days, g["Kanpur"].mean_station_coverage_pct) == (15, 9, 5, 75.0)
    assert (g["Delhi"].longest_gap_days, g["Nowhere"].days_reported, g["Nowhere"].longest_gap_days) == (14, 0, 15)
    c = B.coverage(aq, B.ask(spark, ["Kanpur", "Delhi"], "2024-11-01", "2024-11-10")).orderBy("city").collect()
    assert [(r.city, r.days_reported, r.pct_days_reported, r.low_coverage) for r in c] == [("Delhi", 0, 0.0, True), ("Kanpur", 9, 90.0, False)]
    assert B.coverage(aq, B.ask(spark, [], "2024-11-01", "2024-11-10")).count() == 0
    assert B.missing_days(aq.select(aq.date.alias("day")), "2024-11-04", "2024-11-06").collect()[0].day == D(2024, 11, 5)


def test_reports(spark, aq):
    from lodestream.plans import reports

    cities = spark.createDataFrame([("Kanpur",)], "city string")
    assert "| Kanpur | 15 | 9 | 60.0 | 0 | 75.0 | 5 |" in reports.quality_report(aq, cities)
    assert reports.compare_runs({"a": {"mrr": 0.5}, "b": {"recall": 1.0}}).splitlines()[2] == "| a | 0.5 | - |"
