"""Configured retrieval, model calls and evaluation runs."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lodestream import config
from lodestream.operators import retrieve as R
from lodestream.plans import answer, models, retriever, run
from lodestream.schemas import CATEGORIES
from tests.test_bulletins import TABLE, D

CHUNKS = [
    ("d1::c0", "d1", "d1::s0", "construction dust must be covered under stage three"), ("d1::c1", "d1", "d1::s0", "construction sites stop work under stage four"),
    ("d2::c0", "d2", "d2::s0", "old rules on construction dust of an earlier year"), ("d3::c0", "d3", "d3::s0", "schools close when the index is severe"), ("d3::c1", "d3", "d3::s1", "stubble burning and its penalties"),
]
META = [("d1", True), ("d2", False), ("d3", True)]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, parent_id string, text string")
    meta = spark.createDataFrame(META, "doc_id string, is_current boolean")
    parents = spark.createDataFrame([(p, f"whole section {p}", 5) for p in sorted({c[2] for c in CHUNKS})], "parent_id string, text string, token_count int")
    q = spark.createDataFrame([(0, "construction dust rules"), (1, "zzz qqq")], "query_id long, question string")
    return chunks, meta, parents, q


def ask(tables, **retrieval):
    chunks, meta, parents, q = tables
    engine = retriever.over_chunks(config.Pipeline("t", retrieval=config.Retrieval(**retrieval)), chunks, meta, parents, keep=lambda df: df.cache())
    vectors, terms = retriever.question_tables(q, engine.posts)
    return engine, [r for r in engine.retrieve(vectors, terms).orderBy("query_id", "place").collect() if r.query_id == 0]


# Switches as configurations of a study put them: from plain vectors to everything at once.
SWITCHES = [
    dict(sparse=False, rerank=False), dict(dense=False, rerank=False), dict(rerank=False), dict(fusion="weighted", alpha=0.3, rerank=False), dict(), dict(current_only=False),
    dict(rerank_threshold=0.9), dict(rerank_threshold=0.5, rerank_threshold_mode="filter"), dict(mmr=True, small_to_big=True, reorder=True, k_final=3),
]


@pytest.mark.parametrize("switches", SWITCHES, ids=str)
def test_switches(tables, switches):
    engine, got = ask(tables, **switches)
    r = engine.cfg.retrieval
    ids = [x.id for x in sorted(got, key=lambda x: x["rank"])]
    assert len(ids) <= r.k_final and (not r.current_only or not any(i.startswith("d2") for i in ids))
    if r.rerank_threshold == 0.9:
        assert not ids  # the best candidate holds two of three words
    elif r.rerank_threshold == 0.5:
        assert ids == ["d1::c0"]
    elif not r.current_only:
        assert ids[0] == "d2::c0"
    elif not r.dense:
        assert ids == ["d1::c0", "d1::c1"]
    else:
        assert ids[0] == "d1::c0"
    if r.small_to_big:
        assert got[0].text.startswith("whole section") and len({x.expanded_from for x in got}) == len(got)
    if r.reorder and len(got) > 2:
        assert [x["rank"] for x in got][0] == 1 and [x["rank"] for x in got][-1] == 2


def test_what_a_configuration_needs(tables):
    with pytest.raises(ValueError, match="neither"):
        retriever.Retriever(config.Pipeline("t", retrieval=config.Retrieval(dense=False, sparse=False)))
    with pytest.raises(ValueError, match="vectors"):
        retriever.Retriever(config.Pipeline("t"))
    with pytest.raises(ValueError, match="parents"):
        chunks, *_ = tables
        retriever.over_chunks(config.Pipeline("t", retrieval=config.Retrieval(small_to_big=True)), chunks)


def scripted(*steps):
    it, log = iter(steps), []

    def call(model, system, user):
        log.append(model)
        step = next(it)
        if isinstance(step, Exception):
            raise step
        return step, {"tokens": 3}

    return call, log


def test_model_calls_back_off_and_fall_back():
    waited = []
    call, log = scripted(models.Busy(), models.Busy(), '{"a": 1}')
    found, usage = models.ask_json(call, ["m"], "s", "u", sleep=waited.append)
    assert found == {"a": 1} and waited == [3.0, 6.0] and usage.model == "m" and usage.calls == 3 and usage.used == {"tokens": 3}
    call, log = scripted(models.Spent(), "{}")
    assert models.ask_json(call, ["m", "n"], "s", "u", sleep=waited.append)[1].model == "n" and log == ["m", "n"] and len(waited) == 2
    call, log = scripted(*[models.Busy()] * 8)
    with pytest.raises(models.Unavailable):
        models.ask_json(call, ["m", "n"], "s", "u", sleep=waited.append)
    assert log == ["m"] * 4 + ["n"] * 4
    for bad in ("no json", "[1]"):
        with pytest.raises(ValueError):
            models.ask_json(scripted(bad)[0], ["m", None], "s", "u")
    with pytest.raises(KeyError):
        models.ask_json(scripted(KeyError("x"))[0], ["m"], "s", "u")


def test_router_by_model(spark):
    good = {"route": "data", "language": "en", "cities": ["Kanpur"], "time_range": "next week", "policy_subquery": None, "data_subquery": "mean"}
    cfg = config.Pipeline("t", routing=config.Routing(router="model", model="m"))
    ask = lambda text: answer.Assistant(spark, cfg, lambda q: [], {}, lambda q, e, c: "", call=scripted(text)[0])
    bot = ask(json.dumps(good))
    assert bot.route("q") == good | {"time_range": None} and bot.usage.fallback is None
    for bad in ("not json", json.dumps(good | {"route": "weather"}), json.dumps(good | {"cities": "Kanpur"})):
        bot = ask(bad)
        assert bot.route("What does Stage III of GRAP require?")["route"] == "policy" and bot.usage.fallback == "rules"
    with pytest.raises(ValueError):
        answer.Assistant(spark, cfg, lambda q: [], {}, lambda q, e, c: "").route("q")


@pytest.fixture(scope="module")
def views(spark):
    rows = [("Kanpur", D(2024, 11, d), 150 + 30 * d, "Severe" if d > 8 else "Poor", "PM2.5", 3, 4) for d in range(1, 11)]
    return {"city_aqi_daily": spark.createDataFrame(rows, TABLE), "aqi_categories": spark.createDataFrame([("Poor", 4, 201, 300)], CATEGORIES)}


def test_planner_gets_relations_facts_and_examples(spark, views):
    seen = []
    answer.answer_data(spark, "On which weekday is the index of Kanpur lowest?", views, lambda q, e, c: seen.append(c) or "-- no", config.Pipeline("t"))
    assert "severity_rank" in seen[0] and "10 rows" in seen[0] and answer.EXAMPLES[2][1] in seen[0]


def test_sql_evaluation(spark, views):
    plans = {"top": "SELECT date, aqi FROM city_aqi_daily ORDER BY aqi DESC LIMIT 5", "n": "SELECT count(*) FROM city_aqi_daily WHERE aqi > 300", "none": "-- no", "down": models.Unavailable("x"), "bad": "SELECT nope FROM city_aqi_daily"}

    def planner(q, error, context):
        if isinstance(plans[q], Exception):
            raise plans[q]
        return plans[q]

    top = "SELECT date, aqi FROM city_aqi_daily ORDER BY aqi DESC LIMIT 2"
    count = "SELECT count(*) AS n FROM city_aqi_daily WHERE aqi > 300"
    items = [{"id": q, "question": q, "reference_sql": r} for q, r in (("top", top), ("n", count), ("none", None), ("down", count), ("bad", count))]
    got = {r["id"]: r for r in run.evaluate_sql(spark, items, views, planner, config.Pipeline("t"))}
    assert [got[k].get("sql_correct") for k in ("top", "n", "none", "down", "bad")] == [True, True, True, None, False] and "model_error" in got["down"]
    assert not run.sql_correct(spark, top.replace(" LIMIT 2", ""), [(1, 2)], views)


def test_retrieval_and_router_evaluation(spark):
    q = spark.createDataFrame([(1, "What does Stage III of GRAP require?", "policy", "en", "policy", True), (2, "average AQI in Kanpur", "data", "en", "data", False), (3, "Which movie?", "off", "en", "out_of_scope", False)], "query_id long, question string, category string, language string, route string, answerable boolean")
    ranked = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "query_id long, id string, rank int")
    texts = spark.createDataFrame([("c1", "d1", "something else"), ("c2", "d1", "the exact words here")], "id string, doc_id string, form string")
    evidence = spark.createDataFrame([(1, 0, "d1", "exact words")], "query_id long, fact int, doc_id string, quote string")
    rows = {r.query_id: r for r in run.evaluate_retrieval(ranked, q, texts, evidence).collect()}
    assert set(rows) == {1, 3} and rows[1].mrr == 0.5 and not rows[1].abstained and rows[3].abstained and rows[3].mrr is None
    r = run.evaluate_router(q)
    assert r.where("route_ok").count() == 3
    accuracy, confusion = run.router_summary(r)
    assert {x.what: x.mean for x in accuracy.collect()} == {"route": 1.0, "language": 1.0} and {x.gold: x.data for x in confusion.collect()} == {"policy": 0, "data": 1, "out_of_scope": 0}
    s = {(x.metric, x.part): x.mean for x in run.summarise(run.evaluate_retrieval(ranked, q, texts, evidence), ["mrr", "abstained"], resamples=50).collect()}
    assert s == {("mrr", "all"): 0.5, ("mrr", "policy"): 0.5, ("abstained", "answerable"): 0.0, ("abstained", "unanswerable"): 1.0}


def test_sets_of_questions(spark):
    ids = lambda **k: sorted(r.query_id for r in run.chosen(spark.range(20).withColumnRenamed("id", "query_id"), **k).collect())
    assert ids() == list(range(20)) and ids(stride=3) == list(range(0, 20, 3)) and ids(stride=2, offset=2, limit=3) == [4, 6, 8] and ids(limit=0) == []
    for evidence, ok, route in itertools.product((True, False), (True, False), ("data", "policy")):
        row = spark.range(1).select(run.needs_retrieval(F.lit(evidence), F.lit(ok), F.lit(route)).alias("x")).first().x
        assert row == (evidence or (not ok and route != "data"))


def test_percentiles_by_index(spark):
    import random

    from lodestream.operators import evaluate as E

    rnd = random.Random(4)
    rows = [(g, rnd.choice([1.0, 2.5, rnd.random() * 10, None])) for g in ("a", "b", None) for _ in range(rnd.randrange(1, 300))] + [("one", 7.0)]
    got = {r.g: (r.p50, r.p95) for r in E.index_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins=7).collect()}
    for g in {g for g, _ in rows}:
        vs = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g] == (vs[len(vs) // 2], vs[min(len(vs) - 1, int(len(vs) * 0.95))])


def test_filters_reach_the_search(tables):
    engine, _ = ask(tables)
    vectors, terms = retriever.question_tables(tables[3], engine.posts)
    assert {r.id for r in engine.rank(vectors, terms, R.Filter()).where("query_id = 0").collect()} >= {"d2::c0"}
