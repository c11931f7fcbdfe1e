"""Evaluation: retrieval metrics over evidence, result sets, bootstrap, confusion, thresholds, summaries."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(ranked: DataFrame, texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id``, ``fact``, ``rank``: the best rank at which a listed text of the right document covers a fact.

    ``texts``: id, doc_id, form (comparison form); ``evidence``: query_id, fact, doc_id, quote (comparison form), a row for
    each alternative.
    """
    from lodestream.functions.text import covers

    j = ranked.join(texts, "id").join(evidence, ["query_id", "doc_id"])
    return j.where(covers(F.col("form"), F.col("quote"))).groupBy("query_id", "fact").agg(F.min("rank").alias("rank"))


def retrieval_metrics(hits: DataFrame, facts: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), cut: int = 10) -> DataFrame:
    """Per query of ``facts`` (query_id, n_facts): recall, MRR and nDCG at each k, over the first ``cut`` ranks.

    A row gains once, at the rank where it covers a fact that no better row covers; that is the distinct best
    ranks of the facts.
    """
    hits = hits.where(F.col("rank") <= cut)
    gains = hits.select("query_id", "rank").distinct()
    recall = hits.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"got_{k}") for k in ks])
    dcg = gains.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks])
    j = facts.join(recall, "query_id", "left").join(dcg, "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_facts").cast("int"))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    cols = [F.round(F.coalesce(F.col(f"got_{k}") / F.col("n_facts"), F.lit(0.0)), 6).alias(f"recall_{k}") for k in ks]
    cols += [F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr")]
    cols += [F.round(F.coalesce(F.col(f"dcg_{k}") / ideal(k), F.lit(0.0)), 6).alias(f"ndcg_{k}") for k in ks]
    return j.select("query_id", *cols)


def bootstrap(values: DataFrame, groups: Sequence[str], value: str, resamples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Mean and percentile interval per group over ``resamples`` draws with replacement.

    The draw is a non-linear integer hash of resample and position, the same everywhere. Values are put in an
    array per group (evaluation sets are small: one value per question); null values are left out.
    """
    g = values.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("vs"))
    n = F.size("vs")
    draws = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    each = g.select(*groups, "vs", draws.alias("r"))

    def drawn(d):
        x = F.pmod(F.col("r").cast("long") * 100003 + d.cast("long") * 1009 + 1, F.lit(1000003))
        at = F.pmod(F.pmod(F.pmod(x * x, F.lit(1000003)) * x + 12345, F.lit(1000003)), n)
        return F.element_at("vs", at.cast("int") + 1)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, d: a + drawn(d))
    means = each.select(*groups, (total / n).alias("m"), n.alias("n"), F.aggregate("vs", F.lit(0.0), lambda a, v: a + v).alias("all"))
    lo, hi = int(resamples * alpha / 2), int(resamples * (1 - alpha / 2)) - 1
    out = means.groupBy(*groups).agg(F.array_sort(F.collect_list("m")).alias("ms"), F.first("n").alias("n"), F.first("all").alias("all"))
    return out.select(*groups, F.col("n").cast("long").alias("n"), F.round(F.col("all") / F.col("n"), 6).alias("mean"), F.round(F.col("ms")[lo], 6).alias("low"), F.round(F.col("ms")[hi], 6).alias("high"))


def confusion(rows: DataFrame, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts of predictions by gold label, a column for each label."""
    return rows.groupBy(F.col(gold).alias("gold")).agg(*[F.count_if(F.col(predicted) == x).alias(x) for x in labels])


def threshold_sweep(scores: DataFrame, bins: int = 1000) -> DataFrame:
    """For every distinct score: shares of answerable kept and unanswerable rejected, balanced accuracy.

    ``scores``: score, answerable. Running counts in two steps, over ``bins`` equal ranges of scores and within each,
    so no task sorts all scores; no join of thresholds and scores.
    """
    per = scores.where("score IS NOT NULL").groupBy("score").agg(F.count_if(F.col("answerable")).alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    ends = per.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("a").alias("ta"), F.sum("u").alias("tu"))
    wide = F.col("hi") > F.col("lo")
    place = F.when(wide, F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(F.lit(0))
    p = per.crossJoin(ends).withColumn("bin", place)  # one row
    by_bin = p.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("u").alias("u"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # ``bins`` rows at most
    before = by_bin.select("bin", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"bin_{c}") for c in "au"])
    within = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = lambda c: F.col(f"bin_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))
    keep = (F.col("ta") - lower("a")) / F.nullif(F.col("ta"), F.lit(0))
    t = p.join(before, "bin").select("score", keep.alias("k"), (lower("u") / F.nullif(F.col("tu"), F.lit(0))).alias("r"))
    return t.select(F.col("score").alias("threshold"), F.round("k", 6).alias("kept"), F.round("r", 6).alias("rejected"), F.round((F.col("k") + F.col("r")) / 2, 6).alias("balanced"))


def best_threshold(sweep: DataFrame, least: float = 0.9) -> DataFrame:
    """The threshold of best balanced accuracy among those that keep enough; of equals the higher."""
    return sweep.where(F.col("kept") >= least).agg(F.max_by("threshold", F.struct("balanced", "threshold")).alias("threshold"))


def index_percentiles(values: DataFrame, groups: Sequence[str], value: str, bins: int = 1000) -> DataFrame:
    """p50 and p95 by index into the sorted values (n // 2 and int(0.95 n)), not interpolated.

    Values are counted, running counts over ``bins`` equal ranges tell in which range a place lies, and only the values of
    that range are put in order; no task sorts a whole group.
    """
    c = values.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__ls_v")).agg(F.count(F.lit(1)).alias("__ls_n"))
    ends = c.groupBy(*groups).agg(F.min("__ls_v").alias("lo"), F.max("__ls_v").alias("hi"), F.sum("__ls_n").alias("n"))
    e = ends.select(*[F.col(g).alias(f"__ls_{g}") for g in groups], "lo", "hi", "n")
    on = [F.col(g).eqNullSafe(F.col(f"__ls_{g}")) for g in groups]
    wide = F.col("hi") > F.col("lo")
    place = F.when(wide, F.floor((F.col("__ls_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(F.lit(0))
    c = c.join(e, on).select(*groups, "__ls_v", "__ls_n", place.alias("__ls_bin"), "n")
    upto = Window.partitionBy(*groups).orderBy("__ls_bin").rowsBetween(Window.unboundedPreceding, -1)  # ``bins`` rows a group
    by_bin = c.groupBy(*groups, "__ls_bin").agg(F.sum("__ls_n").alias("of"), F.first("n").alias("n"))
    by_bin = by_bin.withColumn("before", F.coalesce(F.sum("of").over(upto), F.lit(0)))
    at = {"p50": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))}
    asked = by_bin.select(*groups, "__ls_bin", "before", "of", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("pos")) for k, v in at.items()])).alias("x"))
    asked = asked.where((F.col("before") <= F.col("x.pos")) & (F.col("x.pos") < F.col("before") + F.col("of")))
    asked = asked.select(*[F.col(g).alias(f"__ls_{g}") for g in groups], F.col("__ls_bin").alias("__ls_b"), "before", "x.what", "x.pos")
    near = c.join(asked, [*on, F.col("__ls_bin") == F.col("__ls_b")])
    within = Window.partitionBy(*groups, "what").orderBy("__ls_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("before") + F.sum("__ls_n").over(within)).where(F.col("upto") > F.col("pos"))
    return near.groupBy(*groups).agg(*[F.min(F.when(F.col("what") == k, F.col("__ls_v"))).alias(k) for k in at])


def faithfulness(claims: DataFrame) -> DataFrame:
    """Supported claims over all claims per answer, null without any. ``claims``: answer_id, supported."""
    return claims.groupBy("answer_id").agg((F.count_if(F.col("supported")) / F.nullif(F.count("supported"), F.lit(0))).alias("faithfulness"))


# --- Result sets (rows of at most a thousand, compared on the driver) --------------------------------------

MONTH_LABEL = re.compile(r"^(\d{4})-(\d{2})(?:-\d{2})?$")


def cell(v: object) -> object:
    """A value as it is compared: numbers to one decimal (half to even), texts trimmed in lower case."""
    if v is None or isinstance(v, bool):
        return v
    try:
        return round(float(v), 1) if not isinstance(v, str) else v.strip().lower()
    except (TypeError, ValueError):
        return str(v).strip().lower()


def same_values(a: Sequence, b: Sequence, tolerance: float = 0.15) -> bool:
    """Whether two columns hold the same values in any order, numbers within the tolerance or one per cent."""
    if len(a) != len(b):
        return False
    for x, y in zip(sorted(map(cell, a), key=str), sorted(map(cell, b), key=str)):
        if isinstance(x, float) and isinstance(y, float):
            if math.isnan(x - y) or abs(x - y) > max(tolerance, abs(x) / 100):
                return False
        elif x != y:
            return False
    return True


def results_match(expected: Sequence[Sequence], got: Sequence[Sequence], tolerance: float = 0.15, ranked: bool = False, aligned: bool = False) -> bool:
    """Whether a result has the rows and, whatever their names, the columns of the expected one; more columns may be there.

    ``ranked``: the expected result is a top k, so further rows are fine. A label YYYY-MM may be read as year
    or month. ``aligned``: stricter than matching each column alone, whole rows must correspond.
    """
    got = got[: len(expected)] if ranked and len(got) > len(expected) else got
    if len(expected) != len(got):
        return False
    if not expected:
        return True
    free = list(range(len(got[0])))
    picked = []
    for i in range(len(expected[0])):
        want = [r[i] for r in expected]
        for j in free:
            have = [r[j] for r in got]
            labels = [MONTH_LABEL.match(str(v)) for v in have]
            forms = [have] + ([[int(m[1]) for m in labels], [int(m[2]) for m in labels]] if all(labels) else [])
            fit = next((f for f in forms if same_values(want, f, tolerance)), None)
            if fit is not None:
                free.remove(j)
                picked.append(fit)
                break
        else:
            return False
    if not aligned:
        return True
    rows = sorted((tuple(map(cell, r)) for r in expected), key=str)
    mine = sorted((tuple(cell(c[k]) for c in picked) for k in range(len(got))), key=str)
    return all(same_values([x], [y], tolerance) for a, b in zip(rows, mine) for x, y in zip(a, b))
