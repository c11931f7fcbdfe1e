"""Queries of the evaluation layer. Held-out passages are the questions, documents what is retrieved."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import routing
from lodestream.functions import text as X
from lodestream.operators import evaluate as E
from lodestream.operators import retrieve as R
from lodestream.plans import run
from lodestream.runtime import durable, spread, table

HALF = 12


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items")


def _ranked(s: SparkSession, d: str) -> DataFrame:
    """The ten best documents for every passage, by shared terms."""
    posts = durable(R.postings(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text"))
    words = F.array_distinct(F.filter(F.split(F.lower("passage"), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != ""))
    q = _items(s, d).select(F.col("item_id").alias("query_id"), F.explode(words).alias("term"), F.lit(1.0).alias("weight"))
    return R.sparse_search(q, posts, 10)


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Two facts per passage, its first and last twelve words; any document may hold them."""
    w = F.split(X.comparison_form(F.col("passage")), " ")
    both = F.array(F.array_join(F.slice(w, 1, HALF), " "), F.array_join(F.slice(w, -HALF, HALF), " "))
    return _items(s, d).where(F.size(w) >= HALF).select(F.col("item_id").alias("query_id"), F.posexplode(both).alias("fact", "quote"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", X.comparison_form(F.col("text")).alias("form"))
    ranked = durable(_ranked(s, d))
    evidence = _facts(s, d).join(ranked.select("query_id", F.col("id").alias("doc_id")), "query_id")
    return E.first_ranks(ranked, texts, evidence)


def evidence_coverage(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d).select("query_id", F.col("fact").cast("long").alias("fact"), F.col("rank").cast("long").alias("rank"))


def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    n = _facts(s, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_facts"))
    return E.retrieval_metrics(_hits(s, d), n)


def _questions(s: SparkSession, d: str) -> DataFrame:
    """Held-out items as questions; those of short passages stand for questions that can't be answered."""
    long = F.length("passage") > 400
    return _items(s, d).select(F.col("item_id").alias("query_id"), "question", "category", "language", routing.route(F.col("question")).alias("route"), long.alias("answerable"), "passage")


def retrieval_needed(s: SparkSession, d: str) -> DataFrame:
    """Questions that a run asks the retriever: with evidence, or unanswerable and not of data alone."""
    q = _items(s, d).select("item_id", F.length("passage").alias("n"), F.when(F.col("language") == "hi", "data").otherwise("policy").alias("route"))
    return q.where(run.needs_retrieval(F.col("n") > 450, F.col("n") > 400, F.col("route"))).select("item_id")


def question_sample(s: SparkSession, d: str) -> DataFrame:
    """Every third question, of these forty from the sixth on."""
    return run.chosen(_items(s, d).select(F.col("item_id").alias("query_id")), 3, 5, 40)


def router_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Accuracy with intervals of the rules over documents, against a simpler idea of route (data where a number is asked) and
    the given language."""
    given = F.when(F.col("text").rlike("(?i)average|highest|lowest"), "data").otherwise("policy")
    lang = F.when(F.col("lang") == "hi-Latn", "hinglish").otherwise(F.col("lang"))
    q = table(s, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"), F.col("source").alias("category"), given.alias("route"), lang.alias("language"))
    r = run.evaluate_router(q)
    return r.groupBy("gold_route", "route_pred").agg(F.count(F.lit(1)).alias("n"), F.count_if("language_ok").alias("language_ok"))


def run_summary(s: SparkSession, d: str) -> DataFrame:
    """A run over all held-out items: recall, MRR and nDCG in all and by category with intervals, abstention by answerability."""
    ranked = durable(_ranked(s, d))
    texts = table(s, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", X.comparison_form(F.col("text")).alias("form"))
    evidence = _facts(s, d).join(ranked.select("query_id", F.col("id").alias("doc_id")), "query_id")
    rows = durable(run.evaluate_retrieval(ranked, _questions(s, d), texts, evidence))
    return run.summarise(rows, ["recall_5", "mrr", "ndcg_10", "abstained"])


def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    """Languages as given against languages as detected."""
    q = table(s, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("lang", routing.language(F.col("text")).alias("p"))
    return E.confusion(q, "lang", "p", ("en", "hi", "hinglish"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Documents as questions: answerable where they were labelled, score from their length."""
    labelled = table(s, d, "subject_labels").select("doc_id").distinct().withColumn("l", F.lit(True))
    return table(s, d, "documents").join(labelled, "doc_id", "left").select((F.pmod(F.col("n_chars"), F.lit(211)) / 211.0).alias("score"), F.coalesce("l", F.lit(False)).alias("answerable"), F.col("source").alias("category"), F.col("n_chars"))


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return E.threshold_sweep(_scores(s, d)).withColumn("threshold", F.round("threshold", 9))


def best_threshold(s: SparkSession, d: str) -> DataFrame:
    return E.best_threshold(E.threshold_sweep(_scores(s, d)), 0.5).select(F.round("threshold", 9).alias("threshold"))


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """Intervals of the share of long passages by category of held-out items."""
    v = _items(s, d).select("category", (F.length("passage") > 420).cast("double").alias("v"))
    return E.bootstrap(v, ["category"], "v", 2000)


def latency_index_percentiles(s: SparkSession, d: str) -> DataFrame:
    return E.index_percentiles(table(s, d, "events"), ["event_type"], "value")


def summary_by_category(s: SparkSession, d: str) -> DataFrame:
    """Means by category and in all, with grouping sets."""
    x = _scores(s, d)
    g = x.groupingSets([["category"], []], "category")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(F.col("answerable").cast("double")), 6).alias("answerable"))


def comparison_form(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.comparison_form(F.col("text")).alias("form"))


def faithfulness(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "subject_labels").select(F.col("doc_id").alias("answer_id"), F.col("annotator").isin("a1", "a2").alias("supported"))
    return E.faithfulness(c).select("answer_id", F.round("faithfulness", 6).alias("faithfulness"))


def result_set_match(s: SparkSession, d: str) -> DataFrame:
    """The matcher over small results: same rows under other names, a ranking that goes on, a wrong value."""
    rows = [(r[0], r[1]) for r in table(s, d, "nation").groupBy("n_regionkey").count().orderBy("n_regionkey").collect()]
    cases = {
        "same": E.results_match(rows, [(b, a, "x") for a, b in reversed(rows)]),
        "ranked": E.results_match(rows[:2], rows, ranked=True),
        "wrong": E.results_match(rows, [(a, b + 1) for a, b in rows]),
        "permuted": E.results_match(rows, [(a, b) for a, b in zip([r[0] for r in rows], [r[1] for r in rows][::-1])]),
    }
    return s.createDataFrame(sorted(cases.items()), "name string, matches boolean")


_S = """x AS (SELECT (n_chars % 211) / 211.0::DOUBLE AS score, l.doc_id IS NOT NULL AS answerable, source AS category FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM subject_labels) l USING (doc_id))"""
_SWEEP = f"""{_S}, t AS (SELECT DISTINCT score AS threshold FROM x WHERE score IS NOT NULL), n AS (SELECT count(*) FILTER (WHERE answerable) AS ta, count(*) FILTER (WHERE NOT answerable) AS tu FROM x WHERE score IS NOT NULL),
sw AS (SELECT threshold, count(*) FILTER (WHERE answerable AND score >= threshold) / any_value(ta)::DOUBLE AS k, count(*) FILTER (WHERE NOT answerable AND score < threshold) / any_value(tu)::DOUBLE AS r FROM t, x, n WHERE score IS NOT NULL GROUP BY threshold)"""
# DuckDB has NFC only: compatibility forms of the blocks of Latin, punctuation, numbers and presentation forms, by Unicode's own rule.
_BLOCKS = (range(0xA0, 0x250), range(0x2000, 0x2190), range(0x2460, 0x2500), range(0x3000, 0x3040), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
_FORMS = {chr(k): unicodedata.normalize("NFKC", chr(k)) for b in _BLOCKS for k in b if unicodedata.normalize("NFKC", chr(k)) != unicodedata.normalize("NFC", chr(k))}
_COMPATIBLE = "{" + ", ".join(f"'{c}': '{f.replace(chr(39), chr(39) * 2)}'" for c, f in _FORMS.items()) + "}"
_PLAINED = "t"
for _old, _new in X.PLAIN.items():
    _PLAINED = f"replace({_PLAINED}, '{_old}', '{_new.replace(chr(39), chr(39) * 2)}')"
SQL: dict[str, str] = {
    "confusion_matrix": f"WITH p AS (SELECT lang, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN len(regexp_extract_all(lower(text), '\\b({routing.HINGLISH.replace(' ', '|')})\\b')) >= 2 THEN 'hinglish' ELSE 'en' END AS p FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) SELECT lang AS gold, count(*) FILTER (WHERE p = 'en') AS en, count(*) FILTER (WHERE p = 'hi') AS hi, count(*) FILTER (WHERE p = 'hinglish') AS hinglish FROM p GROUP BY 1",
    "retrieval_needed": "SELECT item_id FROM eval_items WHERE length(passage) > 450 OR (NOT length(passage) > 400 AND language IS DISTINCT FROM 'hi')",
    "question_sample": "SELECT query_id FROM (SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id) - 1 AS n FROM eval_items) WHERE n % 3 = 0 AND n // 3 >= 5 AND n // 3 < 45",
    "threshold_sweep": f"WITH {_SWEEP} SELECT round(threshold, 9) AS threshold, round(k, 6) AS kept, round(r, 6) AS rejected, round((k + r) / 2, 6) AS balanced FROM sw",
    "best_threshold": f"WITH {_SWEEP} SELECT round(threshold, 9) AS threshold FROM sw WHERE round(k, 6) >= 0.5 ORDER BY round((k + r) / 2, 6) DESC, threshold DESC LIMIT 1",
    "bootstrap_ci": """WITH v AS (SELECT category, CASE WHEN length(passage) > 420 THEN 1.0::DOUBLE ELSE 0 END AS v FROM eval_items), g AS (SELECT category, list(v ORDER BY v) AS vs, count(*) AS n, avg(v) AS mean FROM v GROUP BY 1),
      r AS (SELECT category, vs, n, mean, unnest(range(2000)) AS r FROM g), d AS (SELECT *, unnest(range(n)) AS d FROM r), x AS (SELECT *, (r * 100003 + d * 1009 + 1) % 1000003 AS x FROM d),
      m AS (SELECT category, r, any_value(n) AS n, any_value(mean) AS mean, sum(vs[((((x * x % 1000003) * x + 12345) % 1000003) % n) + 1]) / any_value(n) AS m FROM x GROUP BY category, r),
      s AS (SELECT category, any_value(n) AS n, any_value(mean) AS mean, list(m ORDER BY m) AS ms FROM m GROUP BY 1) SELECT category, n, round(mean, 6) AS mean, round(ms[51], 6) AS low, round(ms[1950], 6) AS high FROM s""",
    "latency_index_percentiles": "WITH l AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[len(v) // 2 + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT)) + 1] AS p95 FROM l",
    "summary_by_category": f"WITH {_S} SELECT category, count(*) AS n, round(avg(score), 6) AS mean, round(avg(CASE WHEN answerable THEN 1.0::DOUBLE ELSE 0 END), 6) AS answerable FROM x GROUP BY GROUPING SETS ((category), ())",
    "comparison_form": f"""WITH k AS (SELECT MAP {_COMPATIBLE} AS m), c AS (SELECT doc_id, nfc_normalize(array_to_string(list_transform(string_split(text, ''), lambda c: coalesce(m[c], c)), '')) AS t FROM documents, k)
      SELECT doc_id, trim(regexp_replace(regexp_replace(lower({_PLAINED}), '[|*_`#]', ' ', 'g'), '[\\t-\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS form FROM c""",
    "faithfulness": "SELECT doc_id AS answer_id, round(count(*) FILTER (WHERE annotator IN ('a1', 'a2')) / count(annotator)::DOUBLE, 6) AS faithfulness FROM subject_labels GROUP BY 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        evidence_coverage, retrieval_metrics, retrieval_needed, question_sample, router_accuracy, run_summary, confusion_matrix, threshold_sweep, best_threshold, bootstrap_ci, latency_index_percentiles, summary_by_category,
        comparison_form, faithfulness, result_set_match,
    )
}
