import numpy as np
import pandas as pd
import pyarrow as pa

from lodestream.operators import retrieve as R
from lodestream.operators import sparse as S


class Sent:
    def __init__(self, value):
        self.value = value


def corpus(rnd, n, topics=20, own=40, common=30):
    """Texts of a few topics, some much longer than others, some of them twice."""
    rows = []
    for i in range(n):
        topic, size = rnd.integers(topics), int(rnd.choice([10, 30, 60, 200], p=[0.3, 0.4, 0.28, 0.02]))
        rows.append(np.unique(np.where(rnd.random(size) < 0.7, topic * own + rnd.integers(own, size=size), topics * own + rnd.integers(common, size=size)), return_counts=True))
    return [rows[i // 2] if i % 50 == 1 else rows[i] for i in range(n)], topics * own + common


def test_few_products_are_made_and_the_best_are_all_there():
    rnd = np.random.default_rng(3)
    rows, width = corpus(rnd, 6000)
    idf = rnd.uniform(0.5, 3, width)
    x = np.zeros((len(rows), width))
    for i, (t, n) in enumerate(rows):
        x[i, t] = n * idf[t]
    names = np.array([f"t{i:04}" for i in range(width)])
    q = pd.DataFrame([(i, t, x[i, t]) for i in range(0, len(rows), 40) for t in rows[i][0]], columns=["query_id", "code", "weight"])
    asked, k = S.Asked(q, pa.array(names)), 10
    scores = x[asked.ids.to_numpy()] @ x.T
    longest = np.argsort(-np.linalg.norm(x, axis=1))[:1500]
    asked.floor = np.partition(scores[:, longest], -k)[:, -k] * (1 - 1e-4)
    asked.floor[0] = 0  # one query without a floor
    asked.sorted_by_reach().fit()
    made, whole = 0, S.Texts.products

    def counted(self, text, query, weight):
        nonlocal made
        made += len(text)
        return whole(self, text, query, weight)

    S.Texts.products = counted
    try:
        batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 2000)), pa.array([names[t].tolist() for t, _ in rows[a : a + 2000]]), pa.array([x[i, rows[i][0]].tolist() for i in range(a, a + 2000)])], names=["id", "t", "w"]) for a in range(0, 6000, 2000)]
        found = pa.Table.from_batches(list(S.search(Sent(asked), k, ["query_id", "id", "score"])(iter(batches)))).to_pandas()
    finally:
        S.Texts.products = whole
    assert made < 0.1 * scores.size
    found["score"] = found["score"].round(6)
    got = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k).groupby("query_id")["id"].agg(list).to_dict()
    for i in range(0, len(rows), 40):
        s = np.round(x[i] @ x.T, 6)
        assert got[i] == [j for j in sorted(np.flatnonzero(s > 0), key=lambda j: (-s[j], j))[:k]]


def test_lists_are_the_postings(spark):
    docs = spark.createDataFrame([(1, "smog smog rules"), (2, "Rules of traffic"), (3, ""), (4, None), (5, "SMOG!"), (1, "rules, smog"), (None, "of वायु"), (6, " . ")], "id long, text string").repartition(3)
    row = lambda r: (r.id, r.term, r.tf, round(r.weight, 9))
    once = docs.where("id IN (2, 3, 4, 5, 6)")
    assert {row(r) for r in S.long(S.posting_lists(once, "id", "text")).collect()} == {row(r) for r in R.postings(once, "id", "text").collect()}
    assert {(r.id, r.term, r.tf) for r in S.long(S.posting_lists(docs, "id", "text")).collect()} == {(r.id, r.term, r.tf) for r in R.postings(docs, "id", "text").collect()}


def test_weights_below_zero_and_short_tables(spark):
    posts = spark.createDataFrame([(i, f"t{j}", float((i * j) % 7 - 2)) for i in range(1, 60) for j in range(1, 6)], "id long, term string, weight double")
    q = spark.createDataFrame([(1, "t1", 1.0), (1, "t3", -2.0), (1, "t1", 0.5), (2, "t2", 1.0), (3, "none", 1.0)], "query_id int, term string, weight double")
    w = {(r.id, r.term): r.weight for r in posts.collect()}
    s1, s2 = {i: 1.5 * w[i, "t1"] - 2 * w[i, "t3"] for i in range(1, 60)}, {i: w[i, "t2"] for i in range(1, 60)}
    got = R.sparse_search(q, posts, 4).collect()
    for n, s in ((1, s1), (2, s2)):
        assert [r.id for r in sorted((r for r in got if r.query_id == n), key=lambda r: r.rank)] == sorted(s, key=lambda i: (-s[i], i))[:4]
    assert {r.query_id for r in got} == {1, 2}
    assert R.sparse_search(q.where("query_id > 3"), posts, 4).count() == 0


def test_overlap_is_counted_in_one_scan_of_the_lists(spark):
    rnd = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rnd.integers(40, size=int(rnd.integers(0, 30))))) for i in range(300)], "id long, text string").repartition(3)
    lists = S.posting_lists(docs, "id", "text")
    posts = S.long(lists)
    q = posts.where("id % 20 = 0").selectExpr("id AS query_id", "term", "weight")
    pairs = [(int(a), int(b), n) for n, (a, b) in enumerate({(20 * rnd.integers(17), rnd.integers(320)) for _ in range(400)})]
    cand = spark.createDataFrame(pairs, "query_id long, id long, rank int")
    got = R.overlap_score(q, lists, cand)
    assert "SortMergeJoin" not in str(spark._jvm.PythonSQLUtils.explainString(S.hits(q.select("query_id", "term").distinct(), lists, cand)._jdf.queryExecution(), "simple"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.overlap_score(q, posts, cand).select(*got.columns).collect()))


def test_equal_texts_and_queries_are_searched_once(spark):
    rnd = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rnd.integers(60, size=int(rnd.integers(3, 40)))) for _ in range(80)]
    docs = spark.createDataFrame([(n, texts[n % 80 if n < 900 else 0]) for n in range(960)], "id long, text string").repartition(3)
    lists = S.posting_lists(docs, "id", "text")
    distinct, copies = S.once(lists, 7)
    assert distinct.count() == 80 and copies.groupBy("id").count().where("count > 7").count() == 0
    q = lists.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    asked = S.asked_of(q)
    same = asked.merged()
    assert len(asked.ids) == 4 and same.num_rows == 48  # 4 texts have ids divisible by 20
    posts = S.long(lists)
    by_term = R.sparse_search(posts.where("id % 20 = 0").selectExpr("id AS query_id", "term", "weight"), posts, 7)
    got = R.sparse_search(q, lists, 7)
    assert got.count() == 48 * 7
    assert sorted(map(tuple, got.select("query_id", "id", "rank", "score").collect())) == sorted(map(tuple, by_term.select("query_id", "id", "rank", "score").collect()))


def test_overlap_of_more_terms_than_one_pass_takes_is_no_join_of_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in range(i % 9, i % 9 + 12))) for i in range(120)], "id long, text string").repartition(2)
    lists = S.posting_lists(docs, "id", "text")
    posts = S.long(lists)
    q = lists.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    cand = spark.createDataFrame([(a, b, 1) for a in range(0, 120, 20) for b in range(0, 120, 7)], "query_id long, id long, rank int")
    want = sorted(map(tuple, R.overlap_score(posts.where("id % 20 = 0").selectExpr("id AS query_id", "term", "weight"), posts, cand).select("query_id", "id", "rank", "rerank").collect()))
    monkeypatch.setattr(S, "PASS", 30)
    asked, whole = [], S.hits
    monkeypatch.setattr(S, "hits", lambda *a: asked.append(1) or whole(*a))
    assert sorted(map(tuple, R.overlap_score(q, lists, cand).select("query_id", "id", "rank", "rerank").collect())) == want
    assert len(asked) == 3


def test_words_are_cut_as_patterns_cut_them(spark):
    texts = ["", "a", " वायु  प्रदूषण—PM2.5, ", "İstanbul Σ’ς", "x\u00adY Ⅳ ⓐ 𝒳y", "é e\u0301", ",", "no end", "end", "न"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string").selectExpr("id", "lower(x) AS x")
    want = [r.w for r in t.select("id", S.words("x").alias("w")).orderBy("id").collect()]
    size, w = S.split(t.orderBy("id").toArrow()["x"].combine_chunks().cast(pa.string()), S.word_characters(spark))
    ends = np.append(0, np.cumsum(size))
    assert [w.to_pylist()[a:b] for a, b in zip(ends, ends[1:])] == want
    bad = S._valid(pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 3], np.int32)), pa.py_buffer(b"a\xffb")]))
    assert bad.to_pylist() == ["a\ufffdb"]


def test_floors_are_of_all_the_longest_texts_whatever_the_terms(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rnd.integers(300, size=30))) for i in range(400)], "id long, text string").repartition(2)
    lists = S.posting_lists(docs, "id", "text")
    q = lists.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    x = np.zeros((400, 300))
    for r in S.long(lists).collect():
        x[r.id, int(r.term[1:])] = r.weight
    monkeypatch.setattr(S, "CELLS", 2000)  # 40 texts at once
    asked = S.asked_of(q)
    S.set_floors(asked, lists, 5)
    want = np.sort(x[asked.ids.to_numpy()] @ x.T, axis=1)[:, -5]
    assert (asked.floor <= want).all() and (asked.floor > 0.999 * want).all()
