import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import retrieve as R

LIST = "query_id int, id string, rank int, score double"


def ranked(spark, ids, q=1):
    return spark.createDataFrame([(q, i, k, 1 / k) for k, i in enumerate(ids, 1)], LIST)


def order(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_rrf_by_hand(spark):
    out = R.rrf([ranked(spark, "abc"), ranked(spark, "cxa")])
    assert order(out) == ["a", "c", "b", "x"]
    s = {r.id: r.score for r in out.collect()}
    assert s["a"] == s["c"] == round(1 / 61 + 1 / 63, 9) and s["b"] == s["x"] == round(1 / 62, 9)


def test_weighted_by_hand(spark):
    out = {r.id: r.score for r in R.weighted(ranked(spark, "abc"), ranked(spark, "ca")).collect()}
    assert out == {"a": 0.5, "b": 0.125, "c": 0.5}
    assert [r.scaled for r in R.min_max(ranked(spark, "a")).collect()] == [1.0]
    assert R.rrf([ranked(spark, ""), ranked(spark, "")]).count() == 0


@given(st.lists(st.permutations("abcdef"), min_size=1, max_size=3))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_rrf_matches_specification(spark, lists):
    want, seen = {}, []
    for one in lists:
        for k, i in enumerate(one, 1):
            want[i] = want.get(i, 0) + 1 / (60 + k)
            seen += [i] if i not in seen else []
    expected = sorted(want, key=lambda i: (-round(want[i], 9), seen.index(i)))
    assert order(R.rrf([ranked(spark, x) for x in lists])) == expected


def test_dense_search_is_exact_and_filtered(spark):
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(300, 8)).round(2)
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(300)] + [(300, None, 1)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, kind int").repartition(5)
    q = df.where("id < 4").select(F.col("id").alias("query_id"), "vector")
    got = R.dense_search(q, df, 7, F.col("kind") == 1).collect()
    f32 = v.astype("float32").astype(float)
    for a in range(4):
        scores = {i: round(float(f32[a] @ f32[i]), 6) for i in range(300) if i % 3 == 1}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:7]
        assert [r.id for r in sorted((r for r in got if r.query_id == a), key=lambda r: r.rank)] == want
    assert R.dense_search(q.where("query_id > 9"), df, 3).count() == 0


def test_sparse_search(spark):
    docs = spark.createDataFrame([(1, "smog smog rules"), (2, "rules of traffic"), (3, ""), (4, None), (5, "SMOG!")], "id long, text string")
    posts = R.postings(docs, "id", "text")
    assert {(r.id, r.term, r.tf) for r in posts.collect()} >= {(1, "smog", 2), (5, "smog", 1)}
    q = spark.createDataFrame([(1, "smog", 1.0), (2, "absent", 1.0)], "query_id int, term string, weight double")
    assert [(r.query_id, r.id, r.rank) for r in R.sparse_search(q, posts, 5).orderBy("rank").collect()] == [(1, 1, 1), (1, 5, 2)]


def test_rerank_modes(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.2), (1, "b", 2, 0.8), (1, "c", 3, 0.8), (2, "d", 1, 0.1)], "query_id int, id string, rank int, rerank double")
    assert order(R.rerank(df.where("query_id = 1"))) == ["b", "c", "a"]
    assert {r.id for r in R.rerank(df, 0.5, "gate").collect()} == {"a", "b", "c"}
    assert {r.id for r in R.rerank(df, 0.5, "filter").collect()} == {"b", "c"}


def test_mmr(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("dup", [0.999, 0.0447]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    r = spark.createDataFrame([(1, "a", 1, 0.9), (1, "dup", 2, 0.89), (1, "b", 3, 0.5), (1, "none", 4, 0.1)], LIST)
    assert order(R.mmr(r.where("id <> 'none'"), v, 2, 0.5)) == ["a", "b", "dup"]
    assert order(R.mmr(r.where("id <> 'none'"), v, 2, 1.0)) == ["a", "dup", "b"]
    assert len(order(R.mmr(r, v, 4, 0.5))) == 4


def test_small_to_big_and_order(spark):
    c = spark.createDataFrame([("a", "p1", "ta"), ("b", "p1", "tb"), ("c", "p2", "tc"), ("d", None, "td")], "id string, parent_id string, text string")
    p = spark.createDataFrame([("p1", "whole section", 300), ("p2", "huge", 5000)], "parent_id string, text string, token_count int")
    out = R.small_to_big(ranked(spark, "abcd"), c, p, 1200).orderBy("rank").collect()
    assert [(r.text, r.expanded_from) for r in out] == [("whole section", "a"), ("tc", None), ("td", None)]
    assert [r.rank for r in R.middle_last(ranked(spark, "abcde")).orderBy("place").collect()] == [1, 3, 5, 4, 2]


def test_filters(spark):
    rnd = random.Random(1)
    rows = [(i, i % 3 != 0, [f"c{i % 4}"], "X" if i % 2 else "Y", "act", "en") for i in range(200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (200, None, None, None, None, None)], "id int, is_current boolean, cities array<string>, jurisdiction string, doc_type string, language string")
    f = R.Filter(current_only=True, cities=("c1", "c2"), jurisdictions=("X",), doc_types=("act",), language="en")
    assert all(r.is_current and r.cities[0] in ("c1", "c2") and r.jurisdiction == "X" for r in df.where(f.column()).collect())
    assert df.where(R.Filter().column()).count() == 201


def test_hashed_vectors_and_fingerprint(spark):
    df = spark.createDataFrame([(1, "clean air"), (2, ""), (3, None)], "id int, text string")
    n = {r.id: float(np.linalg.norm(r.vector)) for r in R.hashed_vectors(df, "id", "text").collect()}
    assert n[1] == pytest.approx(1, abs=1e-5) and n[3] == n[2]
    a = R.fingerprint(df, ["id", "text"]).first()
    assert a == R.fingerprint(df.repartition(3), ["id", "text"]).first() != R.fingerprint(df.where("id < 3"), ["id", "text"]).first()
