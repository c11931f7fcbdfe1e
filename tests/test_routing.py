import pytest
from pyspark.sql import functions as F

from lodestream.functions import routing as R


@pytest.fixture(scope="module")
def ask(spark):
    def run(q):
        return spark.createDataFrame([(q,)], "q string").select(R.routed(F.col("q")).alias("r")).first().r

    return run


@pytest.mark.parametrize(
    ("q", "route"),
    [
        ("What does Stage III of GRAP require?", "policy"), ("What was the average AQI in Kanpur in November 2025?", "data"),
        ("How many days was Delhi Severe last winter and what does Stage IV require?", "mixed"), ("Which air purifier should I buy?", "out_of_scope"),
        ("Who won the cricket match?", "out_of_scope"), ("How many days was Delhi Severe?", "data"), ("प्रदूषण के नियम क्या हैं?", "policy"), ("", "out_of_scope"),
    ],
)
def test_routes(ask, q, route):
    assert ask(q).route == route


@pytest.mark.parametrize(("q", "lang"), [("दिल्ली का AQI", "hi"), ("Delhi mein AQI kitna hai", "hinglish"), ("hai there", "en"), ("ka ka", "hinglish"), ("", "en")])
def test_languages(ask, q, lang):
    assert ask(q).language == lang


@pytest.mark.parametrize(
    ("q", "span"),
    [
        ("winter 2024-25", "2024-11-01/2025-02-28"), ("winter of 2023–2024", "2023-11-01/2024-02-29"), ("November 2025", "2025-11-01/2025-11-30"),
        ("in Feb. 2024", "2024-02-01/2024-02-29"), ("in 2024", "2024-01-01/2024-12-31"), ("maybe", None), ("", None), ("1999", None),
    ],
)
def test_time_ranges(ask, q, span):
    assert ask(q).time_range == span


def test_cities_and_parts(ask):
    r = ask("Compare दिल्ली and kanpur: average AQI")
    assert r.cities == ["Delhi", "Kanpur"] and r.data_subquery and r.policy_subquery is None
    assert ask("Kanpurish AQI").cities == []


def test_history_and_ranges(spark):
    df = spark.createDataFrame([("the superseded order",), ("rules of 1998",), ("current rules",), ("पहले के नियम",)], "q string")
    assert [r.h for r in df.select(R.wants_history(F.col("q")).alias("h")).collect()] == [True, True, False, True]
    bad = spark.createDataFrame([("2024-01-01/2024-02-01",), ("soon",), (None,)], "q string")
    assert [r.o for r in bad.select(R.well_formed_range(F.col("q")).alias("o")).collect()] == ["2024-01-01/2024-02-01", None, None]
