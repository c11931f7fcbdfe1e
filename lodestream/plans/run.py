"""Evaluation of a configuration over a set of questions: retrieval, router, SQL; summaries with intervals.

Questions are a table: query_id, question, category, language, route, answerable. Retrieval and routing take all of them at
once; SQL is planned question by question, and one that fails is a row of its own, not the end of the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.config import Pipeline
from lodestream.functions import routing
from lodestream.operators import evaluate as E
from lodestream.plans.answer import Planner, answer_data
from lodestream.plans.execute import execute
from lodestream.plans.models import ROUTES, Unavailable

#: A reference query that asks for a top k: further rows of an answer are fine.
TOP_K = re.compile(r"\bLIMIT\s+\d+", re.IGNORECASE)


def chosen(questions: DataFrame, stride: int = 1, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Every ``stride``-th question in the order of their ids, of these all from ``offset`` on, ``limit`` at most. A set of
    questions is small and numbered in one place."""
    n = questions.withColumn("__ls_n", F.row_number().over(Window.orderBy("query_id")) - 1).where(F.col("__ls_n") % stride == 0)
    at = (F.col("__ls_n") / stride).cast("long")
    return n.where((at >= offset) & (F.lit(True) if limit is None else at < offset + limit)).drop("__ls_n")


def needs_retrieval(has_evidence: Column, answerable: Column, route: Column) -> Column:
    """Questions with evidence, and unanswerable ones that aren't about data alone."""
    return has_evidence | (~answerable & (route != "data"))


def evaluate_retrieval(ranked: DataFrame, questions: DataFrame, texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row per question that needs retrieval: category, answerable, abstained (nothing was found), and of those with evidence
    (query_id, fact, doc_id, quote) recall, MRR and nDCG over the ten first ranks. ``texts``: id, doc_id, form."""
    facts = evidence.groupBy("query_id").agg(F.countDistinct("fact").alias("n_facts"))
    q = questions.join(facts, "query_id", "left")
    q = q.where(needs_retrieval(F.col("n_facts").isNotNull(), F.col("answerable"), F.col("route"))).drop("n_facts")
    found = ranked.select("query_id").distinct().withColumn("__ls_found", F.lit(True))
    hits = E.first_ranks(ranked.where("rank <= 10"), texts, evidence)
    metrics = E.retrieval_metrics(hits, facts)
    j = q.join(found, "query_id", "left").join(metrics, "query_id", "left")
    return j.withColumn("abstained", F.col("__ls_found").isNull()).drop("__ls_found")


def evaluate_router(questions: DataFrame) -> DataFrame:
    """Each question with the rules' route and language beside the given ones."""
    r = questions.withColumn("__ls_r", routing.routed(F.col("question")))
    return r.select("query_id", "category", F.col("route").alias("gold_route"), F.col("__ls_r.route").alias("route_pred"), (F.col("__ls_r.route") == F.col("route")).alias("route_ok"), (F.col("__ls_r.language") == F.col("language")).alias("language_ok"))


def router_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accuracy of route (with its interval) and language, and the confusion of routes."""
    route = E.bootstrap(rows.select(F.lit("route").alias("what"), F.col("route_ok").cast("double").alias("v")), ["what"], "v")
    language = E.bootstrap(rows.select(F.lit("language").alias("what"), F.col("language_ok").cast("double").alias("v")), ["what"], "v")
    return route.unionByName(language), E.confusion(rows, "gold_route", "route_pred", ROUTES)


def sql_correct(spark: SparkSession, reference: str, got: Sequence[Sequence] | None, views: Mapping[str, DataFrame]) -> bool:
    """Whether a result has what the reference query gives; of a top k the first rows."""
    if got is None:
        return False
    return E.results_match(execute(spark, reference, views, 60).rows, got, ranked=bool(TOP_K.search(reference)))


def evaluate_sql(spark: SparkSession, questions: Sequence[Mapping], views: Mapping[str, DataFrame], planner: Planner, cfg: Pipeline, log: Callable[[str], None] = lambda _: None) -> list[dict]:
    """The planner alone: right where the result matches the reference query's, or where a question without one was declared
    unanswerable. A question that no model answered says nothing of SQL: it has ``model_error`` and isn't counted."""
    rows = []
    for q in questions:
        row: dict = {"id": q["id"], "category": q.get("category")}
        try:
            out = answer_data(spark, q["question"], views, planner, cfg)
            row |= {"sql": out.sql, "attempts": out.attempts, "error": out.error, "unanswerable": out.unanswerable}
            reference = q.get("reference_sql")
            row["sql_correct"] = sql_correct(spark, reference, out.result.rows if out.result else None, views) if reference else out.unanswerable
        except Unavailable as e:
            row["model_error"] = str(e)
        except Exception as e:  # one question never ends the run
            row |= {"error": f"{type(e).__name__}: {e}", "sql_correct": False}
        log(f"{row['id']}: {row.get('sql_correct', 'not counted')}")
        rows.append(row)
    return rows


def summarise(rows: DataFrame, metrics: Sequence[str], groups: Sequence[str] = ("category",), resamples: int = 2000) -> DataFrame:
    """``metric``, ``part`` (all, a category, answerable or unanswerable), n, mean, low, high. Abstention is split by whether a
    question can be answered; all else is by category and in all."""
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics if m != "abstained"]
    parts = F.array(F.lit("all"), *[F.coalesce(F.col(g).cast("string"), F.lit("none")) for g in groups])
    long = None
    if values:
        long = rows.select(parts.alias("ps"), F.explode(F.array(*values)).alias("x")).select(F.explode("ps").alias("part"), "x.metric", "x.v")
    if "abstained" in metrics:
        split = rows.select(F.when(F.col("answerable"), "answerable").otherwise("unanswerable").alias("part"), F.lit("abstained").alias("metric"), F.col("abstained").cast("double").alias("v"))
        long = split if long is None else long.unionByName(split)
    return E.bootstrap(long, ["metric", "part"], "v", resamples)


def latency(rows: DataFrame, seconds: str = "seconds") -> DataFrame:
    return E.index_percentiles(rows.withColumn("what", F.lit("retrieval")), ["what"], seconds)
