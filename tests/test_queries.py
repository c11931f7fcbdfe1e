"""Registered queries over small tables of their own, compared with brute force."""

import datetime as dt
import math
import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from lodestream.plans import q_bulletins, q_documents, q_evaluation, q_retrieval


def save(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_sparse_queries_are_all_documents_divisible_by_20(spark, tmp_path):
    rnd = random.Random(7)
    texts = {k: " ".join(rnd.choice("smog dust rules traffic stage limit ban order".split()) + str(rnd.randrange(6)) for _ in range(12)) for k in range(120)}
    texts[80], texts[100] = None, " .. "
    vectors = [(k, [rnd.random() for _ in range(4)], 1) for k in (*range(45), 140)]
    d = save(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"), embeddings=(vectors, "vec_id long, embedding array<float>, label int"))

    tf = {k: Counter(re.findall(r"\w+", t or "")) for k, t in texts.items()}
    tf = {k: c for k, c in tf.items() if c}
    df = Counter(w for c in tf.values() for w in c)
    weight = {k: {w: n * math.log((len(tf) + 1) / (df[w] + 0.5)) for w, n in c.items()} for k, c in tf.items()}
    want = {}
    for q in (0, 20, 40, 60):
        scores = {k: round(sum(weight[q][w] * v for w, v in t.items() if w in weight[q]), 6) for k, t in weight.items() if weight[q].keys() & t.keys()}
        want[q] = sorted(scores, key=lambda k: (-scores[k], k))[: q_retrieval.K]
    got = {r.query_id: r.ids for r in q_retrieval.sparse_topk(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids")).collect()}
    assert got == want

    asked = lambda f: {r.query_id for r in f(spark, d).select("query_id").distinct().collect()}
    assert asked(q_retrieval.dense_topk) == {0, 20, 40, 140}
    assert asked(q_retrieval.rrf_fusion) == asked(q_retrieval.hybrid_pipeline) == {0, 20, 40, 60, 140}


def plain_form(text):
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text)
    for old, new in (("‘’", "'"), ("“”", '"'), ("–—−", "-")):
        t = re.sub(f"[{old}]", new, t)
    return re.sub(r"\s+", " ", re.sub(r"[|*_`#]", " ", t.lower())).strip()


def test_comparison_form_takes_every_document(spark, tmp_path):
    texts = ["Plain | **text**", "“Limit” – of ‘PM’ — 60−80", "वायु  गुणवत्ता सूचकांक", "Café ﬁne ½ Ｋ", "µg μg ²", "# _Ärger_", "", None]
    d = save(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.form for r in q_evaluation.comparison_form(spark, d).collect()} == {k: plain_form(t) for k, t in enumerate(texts)}


def test_clean_prose_takes_every_block(spark, tmp_path):
    texts = ["imple-\nmentation  of\trules", "वायु \n गुणवत्ता", "a b  c", "no\u00a0break\u2003space", "soft­hyphen — café　x", " ", "", None]
    rows = [(f"b{k}", "text", t) for k, t in enumerate(texts)] + [("t", "table", "|é|")]
    d = save(spark, tmp_path, parsed_blocks=(rows, "block_id string, kind string, text string"))
    want = {f"b{k}": re.sub(r"\s+", " ", re.sub(r"([a-z])-\n([a-z])", r"\1\2", t)).strip() for k, t in enumerate(texts) if t is not None}
    assert {r.block_id: r.text for r in q_documents.clean_prose(spark, d).collect()} == want


def test_landing_gaps_take_every_city(spark, tmp_path):
    first, last = map(dt.date.fromisoformat, (q_bulletins.FIRST, q_bulletins.LAST))
    days = [first + dt.timedelta(k) for k in range((last - first).days + 1)]
    rows = [(("Jabalpur", "Kanpur", None)[k % 3], x) for k, x in enumerate(days) if k not in (4, 100)] + [("Kanpur", None)]
    d = save(spark, tmp_path, city_aqi_daily=(rows, "city string, date date"))
    assert sorted(r.day for r in q_bulletins.landing_gaps(spark, d).collect()) == [days[4], days[100]]


def test_pages_for_ocr_take_pages_without_text(spark, tmp_path):
    rows = [("a", 1, 0, None), ("a", 1, 1, None), ("a", 2, 0, "x" * 200), ("a", 2, 1, " " + "y" * 100), ("a", 3, 0, " short "), ("a", 3, 1, None), ("b", 1, 0, "")]
    d = save(spark, tmp_path, parsed_blocks=(rows, "doc_id string, page int, block_no int, text string"))
    assert {tuple(r) for r in q_documents.pages_for_ocr(spark, d).collect()} == {("a", 1, 0), ("a", 3, 5), ("b", 1, 0)}
