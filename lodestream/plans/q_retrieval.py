"""Queries over vectors and postings: search, fusion, reranking, diversity, context, routing.

Dense queries are all vectors whose id is divisible by 20, sparse queries all documents whose id is, each against
all; ids of vectors and documents are one id space. Fused are the lists of either kind: a query that only one
table has keeps the one list it gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.config import Pipeline, Retrieval
from lodestream.functions import routing
from lodestream.operators import documents as D
from lodestream.operators import retrieve as R
from lodestream.operators import sparse as sparse_lists
from lodestream.plans import answer
from lodestream.plans.q_documents import SECTIONS_SQL as _SECTIONS
from lodestream.plans.retriever import Retriever
from lodestream.runtime import spread, table

K = 10
_LIST = ("query_id", "id", "rank", "score")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text")).where("text IS NOT NULL")


def _posts(s: SparkSession, d: str) -> DataFrame:
    return R.postings(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _lists(s: SparkSession, d: str) -> DataFrame:
    return sparse_lists.posting_lists(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _asked_terms(lists: DataFrame) -> DataFrame:
    return lists.where("id % 20 = 0").withColumnRenamed("id", "query_id").select("query_id", "t", "tf", "w")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "score")


def dense(s: SparkSession, d: str, k: int = 50) -> DataFrame:
    return R.dense_search(_asked(s, d), _vectors(s, d), k)


def sparse(s: SparkSession, d: str, k: int = 50, posts: DataFrame | None = None) -> DataFrame:
    posts = _lists(s, d) if posts is None else posts
    return R.sparse_search(_asked_terms(posts), posts, k)


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _ranked(dense(s, d, K))


def filtered_dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _ranked(R.dense_search(_asked(s, d), _vectors(s, d), K, F.col("label").isin(1, 2, 3)))


def sparse_postings(s: SparkSession, d: str) -> DataFrame:
    return _posts(s, d).select("id", "term", "tf", F.round("weight", 6).alias("weight"))


def sparse_topk(s: SparkSession, d: str) -> DataFrame:
    return _ranked(sparse(s, d, K))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return _ranked(R.rrf([dense(s, d), sparse(s, d)]))


def weighted_fusion(s: SparkSession, d: str) -> DataFrame:
    return _ranked(R.weighted(dense(s, d), sparse(s, d), 0.5)).withColumn("score", F.round("score", 6)).drop("rank")


def _scored(s: SparkSession, d: str) -> DataFrame:
    posts = _lists(s, d)
    fused = R.rrf([dense(s, d), sparse(s, d, posts=posts)]).where("rank <= 30")
    return R.overlap_score(_asked_terms(posts), posts, fused)


def rerank_gate(s: SparkSession, d: str) -> DataFrame:
    return R.rerank(_scored(s, d), 0.999, "gate").select("query_id", "id", F.col("rank").cast("long").alias("rank"), "rerank")


def rerank_filter(s: SparkSession, d: str) -> DataFrame:
    return R.rerank(_scored(s, d), 0.3, "filter").select("query_id", "id", F.col("rank").cast("long").alias("rank"), "rerank")


def mmr_topk(s: SparkSession, d: str) -> DataFrame:
    return R.mmr(dense(s, d, 30), _vectors(s, d), K, 0.7)


def _configured(s: SparkSession, d: str, **retrieval) -> DataFrame:
    """The asked vectors and documents through a retriever of that configuration."""
    cfg = Pipeline("query", retrieval=Retrieval(current_only=False, **retrieval))
    posts = _lists(s, d)
    found = Retriever(cfg, _vectors(s, d).select("id", "vector"), posts).retrieve(_asked(s, d), _asked_terms(posts))
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def hybrid_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Both searches, fusion, reranking of the first 30, the six best in their order for reading."""
    return _configured(s, d, reorder=True)


def dense_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Vectors alone, reranked, behind a gate: a list whose best score is too low is empty."""
    return _configured(s, d, sparse=False, rerank_threshold=0.999)


def sparse_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Terms alone, as they come."""
    return _configured(s, d, dense=False, rerank=False, k_final=5)


def lost_in_middle_order(s: SparkSession, d: str) -> DataFrame:
    return R.middle_last(dense(s, d, 7)).select("query_id", "id", F.col("place").cast("long").alias("place"))


def small_to_big(s: SparkSession, d: str) -> DataFrame:
    """Every document's chunks in order as its ranked list, swapped for sections of at most 150 tokens."""
    c = table(s, d, "chunks").select(F.col("chunk_id").alias("id"), "doc_id", "parent_id", "text")
    ranked = c.select(F.col("doc_id").alias("query_id"), "id", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")).alias("rank"))
    parents = D.parents(table(s, d, "parsed_blocks").where("text IS NOT NULL"))
    return R.small_to_big(ranked, c.select("id", "parent_id", "text"), parents, 150).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "expanded_from", F.length("text").cast("long").alias("chars"))


def hashed_embedding_norms(s: SparkSession, d: str) -> DataFrame:
    v = R.hashed_vectors(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return v.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3).alias("norm"))


def collection_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return R.fingerprint(table(s, d, "chunks"), ("chunk_id", "text"))


def language_detect(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", routing.language(F.col("text")).alias("language"))


def time_ranges(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", routing.time_range(F.col("text")).alias("time_range"))


def history_filter(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", (~routing.wants_history(F.col("text"))).alias("current_only"))


def rules_router(s: SparkSession, d: str) -> DataFrame:
    q = _texts(s, d)
    return q.select("doc_id", routing.routed(F.col("text")).alias("r")).select("doc_id", "r.route", "r.language", F.array_join("r.cities", ";").alias("cities"), "r.time_range")


def fewshot_overlap(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("passage").alias("question"))
    ex = s.createDataFrame([(n, e) for n, (e, _) in enumerate(answer.EXAMPLES)], "no long, example string")
    return answer.pick_examples(q, ex).select("query_id", "no", F.col("shared").cast("long").alias("shared"), F.col("rank").cast("long").alias("rank"))


def citation_filter(s: SparkSession, d: str) -> DataFrame:
    """Citations of every document's chunks; shown are those of the first page."""
    c = table(s, d, "chunks").select(F.col("doc_id").alias("query_id"), "chunk_id", "page_start")
    return answer.shown_citations(c.select("query_id", "chunk_id"), c.where("page_start = 1"))


_DENSE = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), dall AS (
  SELECT query_id, vec_id AS id, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score, label FROM embeddings, qv
), dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dall QUALIFY rank <= {k})"""
_POSTS = """words AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
posts AS (SELECT id, term, tf, tf * ln(((SELECT count(DISTINCT id) FROM words) + 1.0::DOUBLE) / (df + 0.5::DOUBLE)) AS weight FROM tf JOIN df USING (term))"""
_SPARSE = """qt AS (SELECT id AS query_id, term, weight FROM posts WHERE id % 20 = 0),
sall AS (SELECT query_id, p.id, round(sum(p.weight * qt.weight), 6) AS score FROM qt JOIN posts p USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sall QUALIFY rank <= {k})"""


def _d(k: int) -> str:
    return _DENSE.replace("{k}", str(k))


def _s(k: int) -> str:
    return _POSTS + ", " + _SPARSE.replace("{k}", str(k))


_FUSED = f"""{_d(50)}, {_s(50)}, fall AS (SELECT query_id, id, round(1.0::DOUBLE / (60 + rank), 12) AS w, 0 AS l, rank FROM dense UNION ALL SELECT query_id, id, round(1.0::DOUBLE / (60 + rank), 12), 1, rank FROM sparse),
fg AS (SELECT query_id, id, round(sum(w), 9) AS score, min(l * 1000 + rank) AS pos FROM fall GROUP BY ALL), fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM fg)"""
_RERANK = f"""{_FUSED}, cand AS (SELECT * FROM fused WHERE rank <= 30), nt AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY 1),
hits AS (SELECT c.query_id, c.id, count(*) AS hits FROM cand c JOIN qt ON qt.query_id = c.query_id JOIN posts p ON p.id = c.id AND p.term = qt.term GROUP BY ALL),
sc AS (SELECT c.query_id, c.id, c.rank AS old, round(coalesce(hits / terms, 0), 6) AS rerank FROM cand c LEFT JOIN nt USING (query_id) LEFT JOIN hits h ON h.query_id = c.query_id AND h.id = c.id),
rr AS (SELECT query_id, id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, old) AS rank FROM sc)"""
_ROUTE = {k: v.replace("'", "''") for k, v in (("h", routing.HINGLISH.replace(" ", "|")), ("domain", routing.DOMAIN), ("data", routing.DATA), ("shop", routing.SHOPPING), ("policy", routing.POLICY), ("past", routing.PAST))}

_MONTHS = routing.MONTHS.replace(" ", "|")
_NUMBER = "CASE " + " ".join(f"WHEN substring(mo, 1, 3) = '{m[:3]}' THEN {k}" for k, m in enumerate(routing.MONTHS.split()[:12], 1)) + " END"
_TIME = f"""WITH e AS (SELECT doc_id, text, regexp_extract(lower(text), 'winter (?:of )?(\\d{{4}})\\s*[-–/]\\s*(\\d{{2,4}})', 1) AS w, regexp_extract(lower(text), '\\b({_MONTHS})\\.? (\\d{{4}})\\b', 1) AS mo,
  regexp_extract(lower(text), '\\b({_MONTHS})\\.? (\\d{{4}})\\b', 2) AS y, regexp_extract(lower(text), '\\b(20\\d\\d)\\b', 1) AS yy FROM documents WHERE text IS NOT NULL), n AS (SELECT *, try_cast(y AS INT) AS yn, {_NUMBER} AS mn FROM e),
tr AS (SELECT doc_id, text, CASE WHEN w <> '' THEN w || '-11-01/' || last_day(make_date(CAST(w AS INT) + 1, 2, 1)) WHEN mo <> '' THEN make_date(yn, mn, 1) || '/' || last_day(make_date(yn, mn, 1)) WHEN yy <> '' THEN yy || '-01-01/' || yy || '-12-31' END AS time_range FROM n)"""
_CITIES = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{c}\\b') OR contains(text, '{h}') THEN '{c}' END" for c, h in routing.CITIES.items())
SQL: dict[str, str] = {
    "dense_topk": f"WITH {_d(K)} SELECT query_id, id, rank, score FROM dense",
    "filtered_dense_topk": f"WITH {_d(K).replace('FROM dall', 'FROM dall WHERE label IN (1, 2, 3)')} SELECT query_id, id, rank, score FROM dense",
    "sparse_postings": f"WITH {_POSTS} SELECT id, term, tf, round(weight, 6) AS weight FROM posts",
    "sparse_topk": f"WITH {_s(K)} SELECT query_id, id, rank, score FROM sparse",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, id, rank, score FROM fused",
    "weighted_fusion": f"""WITH {_d(50)}, {_s(50)}, n AS (
      SELECT query_id, id, 0.5::DOUBLE * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM dense WINDOW w AS (PARTITION BY query_id)
      UNION ALL SELECT query_id, id, 0.5::DOUBLE * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END FROM sparse WINDOW w AS (PARTITION BY query_id))
      SELECT query_id, id, round(round(sum(v), 9), 6) AS score FROM n GROUP BY ALL""",
    "rerank_gate": f"WITH {_RERANK} SELECT query_id, id, rank, rerank FROM rr QUALIFY max(rerank) OVER (PARTITION BY query_id) >= 0.999",
    "rerank_filter": f"WITH {_RERANK} SELECT query_id, id, rank, rerank FROM rr WHERE rerank >= 0.3",
    "hybrid_pipeline": f"WITH {_RERANK} SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 1000000 - rank END) AS place FROM rr WHERE rank <= 6",
    "dense_pipeline": f"WITH {_RERANK.replace(_FUSED, f'{_d(50)}, {_s(50)}, fused AS (SELECT * FROM dense)')} SELECT query_id, id, rank, rank AS place FROM (SELECT *, max(rerank) OVER (PARTITION BY query_id) AS best FROM rr) WHERE best >= 0.999 AND rank <= 6",
    "sparse_pipeline": f"WITH {_s(50)} SELECT query_id, id, rank, rank AS place FROM sparse WHERE rank <= 5",
    "lost_in_middle_order": f"WITH {_d(7)} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 1000000 - rank END) AS place FROM dense",
    "language_detect": f"SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN len(regexp_extract_all(lower(text), '\\b({_ROUTE['h']})\\b')) >= 2 THEN 'hinglish' ELSE 'en' END AS language FROM documents WHERE text IS NOT NULL",
    "history_filter": f"SELECT doc_id, NOT regexp_matches(text, '(?i){_ROUTE['past']}') AS current_only FROM documents WHERE text IS NOT NULL",
    "fewshot_overlap": "WITH ex AS (SELECT * FROM (VALUES "
    + ", ".join(f"({n}, '{e.replace(chr(39), chr(39) * 2)}')" for n, (e, _) in enumerate(answer.EXAMPLES))
    + """) t(no, example)), j AS (SELECT item_id AS query_id, no, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(passage), '[^a-z0-9]+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(example), '[^a-z0-9]+'), lambda x: x <> '')))) AS shared FROM eval_items, ex)
      SELECT query_id, CAST(no AS BIGINT) AS no, shared, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, no) AS rank FROM j QUALIFY rank <= 4""",
    "time_ranges": f"{_TIME} SELECT doc_id, time_range FROM tr",
    "rules_router": f"""{_TIME}, f AS (SELECT doc_id, text, time_range, regexp_matches(text, '(?i){_ROUTE['data']}') AS d, regexp_matches(text, '(?i){_ROUTE['policy']}') AS p, regexp_matches(text, '(?i){_ROUTE['domain']}') AS m, regexp_matches(text, '(?i){_ROUTE['shop']}') AS b,
      list_filter([{_CITIES}], lambda x: x IS NOT NULL) AS c FROM tr)
      SELECT doc_id, CASE WHEN b OR NOT (m OR (len(c) > 0 AND (d OR p))) THEN 'out_of_scope' WHEN d AND p THEN 'mixed' WHEN d THEN 'data' ELSE 'policy' END AS route, l.language, array_to_string(c, ';') AS cities, time_range
      FROM f JOIN (SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN len(regexp_extract_all(lower(text), '\\b({_ROUTE['h']})\\b')) >= 2 THEN 'hinglish' ELSE 'en' END AS language FROM documents) l USING (doc_id)""",
    "small_to_big": f"""WITH {_SECTIONS}, par AS (SELECT concat(doc_id, '::s', lpad(CAST(section_no AS VARCHAR), 3, '0')) AS parent_id, CASE WHEN heading_path <> '' THEN heading_path || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY block_no) AS whole FROM body GROUP BY doc_id, section_no, heading_path),
      r AS (SELECT doc_id AS query_id, chunk_id AS id, parent_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rank FROM chunks),
      j AS (SELECT r.*, whole, coalesce(len(regexp_extract_all(whole, '[^\\t-\\r \\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+')) <= 150, false) AS fits FROM r LEFT JOIN par USING (parent_id))
      SELECT query_id, id, rank, CASE WHEN fits THEN id END AS expanded_from, length(CASE WHEN fits THEN whole ELSE text END) AS chars FROM j QUALIFY NOT fits OR row_number() OVER (PARTITION BY query_id, parent_id, fits ORDER BY rank) = 1""",
    "citation_filter": "SELECT doc_id AS query_id, chunk_id FROM chunks WHERE page_start = 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dense_topk, filtered_dense_topk, sparse_postings, sparse_topk, rrf_fusion, weighted_fusion, rerank_gate, rerank_filter, mmr_topk, small_to_big,
        lost_in_middle_order, hybrid_pipeline, dense_pipeline, sparse_pipeline, hashed_embedding_norms, collection_fingerprint, language_detect, time_ranges, history_filter, rules_router,
        fewshot_overlap, citation_filter,
    )
}
