"""Retrieval algebra over batches of queries: filter, dense and sparse search, fusion, reranking, diversity, context.

A ranked list is a table (query_id, id, rank, score). Every order ends in the id, so ranks are unique.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators import sparse
from lodestream.runtime import durable

#: Queries compared in one pass over the vectors.
QUERY_BLOCK = 2_000
#: Digits that scores are rounded to before they are ranked, so that summation order decides no tie.
DIGITS = 6


@dataclass(frozen=True)
class Filter:
    """A conjunction of what metadata must be; an empty filter lets everything pass."""

    current_only: bool = False
    cities: Sequence[str] = ()
    jurisdictions: Sequence[str] = ()
    doc_types: Sequence[str] = ()
    language: str | None = None

    def column(self) -> Column:
        out = F.lit(True)
        if self.current_only:
            out &= F.col("is_current")
        if self.cities:
            out &= F.arrays_overlap("cities", F.array(*map(F.lit, self.cities)))
        if self.jurisdictions:
            out &= F.col("jurisdiction").isin(*self.jurisdictions)
        if self.doc_types:
            out &= F.col("doc_type").isin(*self.doc_types)
        if self.language:
            out &= F.col("language") == self.language
        return F.coalesce(out, F.lit(False))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank, by rounded score, then id."""
    s = scored.withColumn("score", F.round("score", DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """Exact top k by dot product. ``queries``: query_id, vector; ``vectors``: id, vector; ``keep`` is applied before the search.

    Queries go to the tasks in blocks; each task multiplies matrices and hands on k candidates per query and
    batch, so what is shuffled doesn't grow with the vectors. Null vectors match nothing.
    """
    if keep is not None:
        vectors = vectors.where(keep)
    vectors, queries = vectors.select("id", "vector").dropna(), queries.select("query_id", "vector").dropna()
    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for n in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        found = vectors.mapInArrow(_search(part.toPandas(), k, kind.names), kind)
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def _search(q: pd.DataFrame, k: int, names: list[str]):
    matrix = np.array(q["vector"].tolist(), dtype=np.float64).T if len(q) else None
    ids = pa.array(q["query_id"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if matrix is None or not b.num_rows:
                continue
            v = b.column("vector")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            s = (x @ matrix).T
            order = np.argsort(-np.round(s, DIGITS), axis=1, kind="stable")
            if b.num_rows > k:  # ties at the edge stay in: the global rank decides them
                edge = np.round(np.take_along_axis(s, order[:, k - 1 : k], axis=1), DIGITS)
                qi, at = np.nonzero(np.round(s, DIGITS) >= edge)
            else:
                qi, at = np.nonzero(np.ones_like(s, dtype=bool))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(qi)), b.column("id").take(pa.array(at)), pa.array(s[qi, at])], names=names)

    return kernel


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``term``, ``tf``, ``weight``: words in lower case with term frequency times inverse document frequency."""
    words = sparse.words(F.col(text_col))
    tf = docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.where(F.size(words) > 0).agg(F.count(F.lit(1)).alias("n"))
    idf = df.crossJoin(n).select("term", F.log((F.col("n") + 1.0) / (F.col("df") + 0.5)).alias("idf"))  # one row
    return tf.join(idf, "term").select("id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def sparse_search(query_terms: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """Top k by the dot product over shared terms. ``query_terms``: query_id, term, weight. A query without terms finds nothing.
    ``posts``: id, term, weight, or the lists of ``sparse.posting_lists``; with these the query terms may be some of the lists, their ids as query_id.

    Queries go to the tasks as rows of term codes; every task bounds the products of its texts with all queries and makes those
    that may reach a query's k best. Joining postings and query terms instead would make a row for every shared common word of
    every pair. The postings are read once for each ``sparse.PASS`` terms of queries, which bounds what is sent to the tasks.
    """
    lists = sparse.gathered(posts)
    if sparse.is_lists(query_terms):
        q = query_terms.select("query_id", "t", "w")
    else:
        q = durable(sparse.recoded(query_terms.select("query_id", "term", F.col("weight").cast("double").alias("weight")).dropna(), lists))
    passes, out = max(1, -(-sparse.size_of(q) // sparse.PASS)), None
    lists, copies = sparse.once(lists, k)
    for n in range(passes):
        asked = sparse.asked_of(sparse.block(q, n, passes))
        same = asked.merged()
        kind = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType if same is None else T.LongType()), T.StructField("id", posts.schema["id"].dataType), T.StructField("score", T.DoubleType())])
        sparse.set_floors(asked, lists, k)
        sent = q.sparkSession.sparkContext.broadcast(asked.sorted_by_reach().fit())
        found = top(lists.mapInArrow(sparse.search(sent, k, kind.names), kind), k)
        if copies is not None:
            found = top(found.drop("rank").join(copies, "id", "left").select("query_id", F.coalesce("copy", "id").alias("id"), "score"), k)
        if same is not None:
            found = found.withColumnRenamed("query_id", "at").join(durable(q.sparkSession.createDataFrame(same)), "at").select("query_id", "id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def fuse(lists: Sequence[DataFrame], weights: Sequence[Column]) -> DataFrame:
    """One list: the sum of what each list gives an id; ties go to the first list, then the better rank in it, then the id.

    ``weights``: of each list the expression of its contribution.
    """
    parts = None
    for n, (one, w) in enumerate(zip(lists, weights)):
        p = one.select("query_id", "id", w.alias("w"), F.struct(F.lit(n).alias("l"), "rank", "id").alias("at"), F.col("score").alias(f"score_{n}"))
        parts = p if parts is None else parts.unionByName(p, allowMissingColumns=True)
    g = parts.groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("score"), F.min("at").alias("at"), *[F.max(f"score_{n}").alias(f"score_{n}") for n in range(len(lists))])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "at")
    return g.withColumn("rank", F.row_number().over(w)).drop("at")


def rrf(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion."""
    return fuse(lists, [1.0 / (F.lit(float(k)) + F.col("rank"))] * len(lists))


def min_max(one: DataFrame) -> DataFrame:
    """A list with ``scaled``: its scores from 0 to 1 per query; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return one.withColumn("scaled", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def weighted(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Weighted sum of scaled scores; a missing id counts 0."""
    return fuse([min_max(dense), min_max(sparse)], [F.lit(alpha) * F.col("scaled"), F.lit(1 - alpha) * F.col("scaled")])


def overlap_score(query_terms: DataFrame, posts: DataFrame, candidates: DataFrame) -> DataFrame:
    """A stand-in for a cross-encoder: the share of a query's distinct terms that a candidate holds, as column ``rerank``."""
    candidates = durable(candidates)  # they are read twice
    if sparse.is_lists(query_terms):
        q, n = query_terms, query_terms.select("query_id", F.size("t").alias("terms"))
    else:
        q = query_terms.select("query_id", "term").distinct()
        n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    if sparse.is_lists(posts):
        pairs, hit = candidates.select("query_id", "id"), None
        q = q if sparse.is_lists(q) else durable(q.dropna())
        passes = max(1, -(-candidates.count() // sparse.PAIRS), -(-sparse.size_of(q) // sparse.PASS))
        for at in range(passes):
            part = sparse.hits(sparse.block(q, at, passes), posts, sparse.block(pairs, at, passes))
            hit = part if hit is None else hit.unionByName(part)
    else:
        hit = candidates.select("query_id", "id").join(q, "query_id").join(posts.select("id", "term"), ["id", "term"], "left_semi").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("hits"))
    j = candidates.join(n, "query_id", "left").join(hit, ["query_id", "id"], "left")
    return j.withColumn("rerank", F.round(F.coalesce(F.col("hits") / F.col("terms"), F.lit(0.0)), DIGITS)).drop("terms", "hits")


def rerank(scored: DataFrame, threshold: float | None = None, mode: str = "gate", candidates: int = 30) -> DataFrame:
    """Reordered by ``rerank`` (ties keep their order), the first ``candidates`` only. ``gate`` empties a list whose best score
    is below the threshold, ``filter`` drops the rows below it."""
    s = scored.where(F.col("rank") <= candidates)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "rank")
    s = s.withColumn("new_rank", F.row_number().over(w))
    if threshold is not None and mode == "gate":
        s = s.withColumn("best", F.max("rerank").over(Window.partitionBy("query_id"))).where(F.col("best") >= threshold).drop("best")
    elif threshold is not None:
        s = s.where(F.col("rerank") >= threshold)
    return s.drop("rank").withColumnRenamed("new_rank", "rank")


def mmr(ranked: DataFrame, vectors: DataFrame, k: int, lam: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: k picks by lam * relevance - (1 - lam) * likeness to what is picked, then the rest in order.

    Relevance is min-max scaled (1 where all are equal), likeness the dot product; an id without vector is
    like nothing. Groups are the candidates of one query, ``rerank_candidates`` at most.
    """
    rel = F.coalesce("rerank", "score") if "rerank" in ranked.columns else F.col("score")
    j = ranked.select("query_id", "id", "rank", rel.alias("rel")).join(vectors.select("id", "vector"), "id", "left")
    kinds = T.StructType([j.schema["query_id"], j.schema["id"], T.StructField("rank", T.IntegerType()), T.StructField("picked", T.BooleanType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rel = pdf["rel"].to_numpy(dtype=float)
        span = rel.max() - rel.min()
        rel = (rel - rel.min()) / span if span > 0 else np.ones_like(rel)
        has = pdf["vector"].notna().to_numpy()
        width = next((len(v) for v in pdf["vector"] if v is not None), 1)
        vecs = np.array([v if ok else np.zeros(width) for v, ok in zip(pdf["vector"], has)], dtype=float)
        order, rest = [], list(range(len(pdf)))
        while rest and len(order) < k:
            past = [j for j in order if has[j]]
            like = (vecs[rest] @ vecs[past].T).max(axis=1) * has[rest] if past else np.zeros(len(rest))
            best = rest[int(np.argmax(np.round(lam * rel[rest] - (1 - lam) * like, 12)))]
            order.append(best)
            rest.remove(best)
        out = pdf.iloc[order + rest]
        return pd.DataFrame({"query_id": out["query_id"], "id": out["id"], "rank": np.arange(1, len(out) + 1, dtype="int32"), "picked": np.arange(len(out)) < k})

    return j.groupBy("query_id").applyInPandas(pick, kinds)


def small_to_big(ranked: DataFrame, chunks: DataFrame, parents: DataFrame, most: int = 1200) -> DataFrame:
    """Chunks replaced by their sections where these have ``most`` tokens at most, every section once per query.

    ``chunks``: id, parent_id, text; ``parents``: parent_id, text, token_count. Adds ``text`` and ``expanded_from``.
    """
    p = parents.select("parent_id", F.col("text").alias("p_text"), "token_count")
    j = ranked.join(chunks.select("id", "parent_id", F.col("text").alias("c_text")), "id").join(p, "parent_id", "left")
    fits = F.coalesce(F.col("token_count") <= most, F.lit(False))
    first = F.row_number().over(Window.partitionBy("query_id", "parent_id", fits).orderBy("rank")) == 1
    j = j.withColumn("fits", fits).withColumn("first", first).where("NOT fits OR first")
    return j.select("query_id", "id", "rank", F.when(F.col("fits"), F.col("p_text")).otherwise(F.col("c_text")).alias("text"), F.when(F.col("fits"), F.col("id")).alias("expanded_from"))


def middle_last(ranked: DataFrame) -> DataFrame:
    """``place``: odd ranks first, ascending, then even ranks, descending, so that the best stand at both ends."""
    key = F.when(F.col("rank") % 2 == 1, F.col("rank")).otherwise(F.lit(1_000_000) - F.col("rank"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(key)))


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """``id``, ``vector``: a stand-in embedder: character trigrams hashed to signed dimensions, unit length; zeros for no text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), dims))
            for i, text in enumerate(b["text"]):
                t = f" {(text or '').lower()} "
                grams = np.array([t[k : k + 3] for k in range(len(t) - 2)], dtype=object)
                h = pd.util.hash_array(grams, categorize=len(grams) > 50)
                np.add.at(out[i], (h % np.uint64(dims)).astype(int), np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0))
            size = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"id": b["id"], "vector": list((out / np.where(size == 0, 1, size)).astype("float32"))})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(kernel, schema)


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``n`` and a ``stamp`` of a table's content that doesn't depend on the order of its rows."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).select("n", F.sha2(F.concat_ws(":", "n", "x", "s"), 256).substr(1, 16).alias("stamp"))
