import math

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import evaluate as E

QUOTE = "one two three four five six seven eight nine ten eleven twelve"


def covers(spark, text, quote):
    df = spark.createDataFrame([(text, quote)], "t string, q string")
    return df.select(X.covers(X.comparison_form(F.col("t")), X.comparison_form(F.col("q"))).alias("c")).first().c


def test_coverage(spark):
    assert covers(spark, "The “limit”  is 60 µg", 'the "limit" is 60 μg')
    assert covers(spark, "x one two three four five six y", QUOTE) and covers(spark, "seven eight nine ten eleven twelve", QUOTE)
    assert not covers(spark, "one two three", "one two three four") and covers(spark, "| a | b |", "a b")


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "query_id int, id string, rank int")
    texts = spark.createDataFrame([("a", "d1", "nothing"), ("b", "d2", "fact one here"), ("c", "d1", "fact two")], "id string, doc_id string, form string")
    evidence = spark.createDataFrame([(1, 0, "d2", "fact one"), (1, 0, "d9", "alternative"), (1, 1, "d1", "fact two"), (2, 0, "d2", "nothing")], "query_id int, fact int, doc_id string, quote string")
    hits = E.first_ranks(ranked, texts, evidence)
    facts = spark.createDataFrame([(1, 2), (2, 1)], "query_id int, n_facts long")
    m = {r.query_id: r for r in E.retrieval_metrics(hits, facts, (2, 3)).collect()}
    assert (m[1].recall_2, m[1].recall_3, m[1].mrr) == (0.5, 1.0, 0.5)
    assert m[1].ndcg_3 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert (m[2].recall_3, m[2].mrr, m[2].ndcg_3) == (0, 0, 0)


def test_result_sets():
    ref = [("Kanpur", 301.24), ("Delhi", 250.0)]
    assert E.results_match(ref, [(250.1, 9, "delhi"), (301.2, 8, "KANPUR ")])
    assert not E.results_match(ref, [(250.1, "delhi")]) and not E.results_match(ref, [(9.0, "delhi"), (301.2, "kanpur")])
    assert E.results_match(ref[:1], ref, ranked=True) and not E.results_match(ref[:1], ref)
    assert E.results_match([(7, 1.0)], [("2025-07", 1.0)]) and E.results_match([(2025, 1.0)], [("2025-07-01", 1.0)])
    swapped = [("Kanpur", 250.0), ("Delhi", 301.24)]
    assert E.results_match(ref, swapped) and not E.results_match(ref, swapped, aligned=True)
    assert E.results_match([], []) and E.results_match([(None, True)], [(None, True)])


def test_bootstrap(spark):
    v = spark.createDataFrame([("g", float(x)) for x in (0, 1, 1, 1, 0, 1, 1, 0, 1, 1)] + [("h", None)], "g string, v double")
    r = E.bootstrap(v, ["g"], "v").collect()
    assert len(r) == 1 and r[0].mean == 0.7 and r[0].low < 0.7 < r[0].high and r[0].n == 10


def test_thresholds(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.4, False), (0.8, False), (None, True)], "score double, answerable boolean")
    got = {r.threshold: (r.kept, r.rejected, r.balanced) for r in E.threshold_sweep(df).collect()}
    assert got == {0.4: (1.0, 0.0, 0.5), 0.8: (1.0, 0.5, 0.75), 0.9: (0.5, 1.0, 0.75)}
    assert E.best_threshold(E.threshold_sweep(df), 0.9).first().threshold == 0.8


def test_summaries(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(40)] + [("b", None)], "g string, v double")
    assert [(r.g, r.p50, r.p95) for r in E.index_percentiles(df, ["g"], "v").collect()] == [("a", 20.0, 38.0)]
    c = spark.createDataFrame([("data", "data"), ("data", "policy"), ("mixed", "mixed")], "g string, p string")
    assert {r.gold: (r.data, r.policy) for r in E.confusion(c, "g", "p", ["data", "policy"]).collect()} == {"data": (1, 1), "mixed": (0, 0)}
    f = spark.createDataFrame([(1, True), (1, False), (2, None)], "answer_id int, supported boolean")
    assert {r.answer_id: r.faithfulness for r in E.faithfulness(f).collect()} == {1: 0.5, 2: None}
