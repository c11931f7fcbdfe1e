"""Queries over policy documents: manifest, headings, cleaning, chunking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import documents as D
from lodestream.operators.retrieve import Filter
from lodestream.runtime import spread, table
from lodestream.sources import manifest as M


def blocks(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "parsed_blocks").where("text IS NOT NULL"))


def body_size_mode(s: SparkSession, d: str) -> DataFrame:
    return D.body_sizes(blocks(s, d))


def heading_flags(s: SparkSession, d: str) -> DataFrame:
    return D.heading_flags(blocks(s, d)).select("block_id", "heading")


def heading_levels(s: SparkSession, d: str) -> DataFrame:
    return D.heading_levels(blocks(s, d)).select("block_id", F.col("level_by_size").cast("long").alias("level_by_size"))


def outline(s: SparkSession, d: str) -> DataFrame:
    return D.outline(blocks(s, d))


def pages_for_ocr(s: SparkSession, d: str) -> DataFrame:
    """Pages of under 300 characters; a page of nothing but null blocks has none."""
    b = spread(table(s, d, "parsed_blocks")).select("doc_id", "page", F.struct("block_no", F.trim(F.coalesce("text", F.lit(""))).alias("text")).alias("b"))
    pages = b.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list("b"))["text"], "").alias("text"))
    return D.needs_ocr(pages, least=300).select("doc_id", "page", F.length("text").cast("long").alias("chars"))


def clean_prose(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).where("kind <> 'table'").select("block_id", X.clean_prose(F.col("text")).alias("text"))


def clean_table(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).where("kind = 'table'").select("block_id", X.clean_table(F.col("text")).alias("text"))


def fix_glyphs(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select("block_id", X.fix_glyphs(F.col("text")).alias("text"))


def boilerplate_dropped(s: SparkSession, d: str) -> DataFrame:
    return D.drop_boilerplate(blocks(s, d)).select("block_id")


def clean_documents(s: SparkSession, d: str) -> DataFrame:
    return D.clean_documents(blocks(s, d)).select("block_id", "text")


def heading_paths(s: SparkSession, d: str) -> DataFrame:
    return D.sections(blocks(s, d)).select("block_id", F.col("section_no").cast("long").alias("section_no"), "heading_path")


def structure_parents(s: SparkSession, d: str) -> DataFrame:
    return D.parents(blocks(s, d)).select("parent_id", "heading_path", F.length("text").cast("long").alias("chars"), "token_count")


def structure_chunks(s: SparkSession, d: str) -> DataFrame:
    return D.structure_chunks(blocks(s, d))


def structure_chunks_small(s: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 60 words, so that sections are cut, overlap and tables split."""
    return D.structure_chunks(blocks(s, d), most=60, overlap=12)


def fixed_chunks(s: SparkSession, d: str) -> DataFrame:
    """Windows of 500 words, 50 of them shared with the one before, over all blocks."""
    c = D.fixed_windows(blocks(s, d))
    return c.select("chunk_id", "doc_id", F.trim(F.regexp_replace("text", f"[{D.SPACE}]+", " ")).alias("text"), "page_start", "page_end", "token_count")


def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    return D.chunk_stats(table(s, d, "chunks"))


def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    m = D.with_metadata(table(s, d, "chunks").select("chunk_id", "doc_id"), table(s, d, "manifest"))
    return m.select("chunk_id", "title", "is_current", "published_on", F.array_join("cities", ";").alias("cities"))


def metadata_filter(s: SparkSession, d: str) -> DataFrame:
    f = Filter(current_only=True, doc_types=("act", "order", "circular"), language="en")
    return D.typed_manifest(table(s, d, "manifest")).where(f.column()).select("doc_id")


def manifest_sync_status(s: SparkSession, d: str) -> DataFrame:
    """Landed hashes stand in: title hashes, a fifth of the known ones kept as they are, every seventh document not landed."""
    m = table(s, d, "manifest")
    h = F.pmod(F.length("title") + F.length("source_url"), F.lit(5))
    landed = m.where(F.pmod(F.length("title"), F.lit(7)) != 0).select("doc_id", F.when(h == 0, F.sha2("title", 256)).otherwise(F.coalesce(F.nullif("sha256", F.lit("")), F.sha2("title", 256))).alias("sha256"), F.lit(None).cast("string").alias("error"))
    return M.sync_status(m, landed)


def sync_histogram(s: SparkSession, d: str) -> DataFrame:
    return M.status_histogram(manifest_sync_status(s, d))


def unparsed_documents(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest")
    return M.unparsed(m, m.where("is_current = 'true'")).select("doc_id")


_B = "b AS (SELECT * FROM parsed_blocks WHERE text IS NOT NULL)"
SECTIONS_SQL = f"""{_B}, s AS (
  SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w AS raw, least(coalesce(level, 1), 3) AS lv,
    trim(substring(regexp_replace(text, '\\s+', ' ', 'g'), 1, 80)) AS title
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)
), h AS (SELECT doc_id, raw, lv, title FROM s WHERE kind = 'heading'),
open AS (
  SELECT x.doc_id, x.raw, k.k, (SELECT CASE WHEN y.lv = k.k THEN y.title END FROM h y WHERE y.doc_id = x.doc_id AND y.raw <= x.raw AND y.lv <= k.k ORDER BY y.raw DESC LIMIT 1) AS t
  FROM (SELECT DISTINCT doc_id, raw FROM s) x CROSS JOIN (VALUES (1), (2), (3)) k(k)
), paths AS (SELECT doc_id, raw, coalesce(string_agg(t, ' › ' ORDER BY k), '') AS heading_path FROM open GROUP BY ALL
), body AS (
  SELECT s.*, p.heading_path, dense_rank() OVER (PARTITION BY s.doc_id ORDER BY s.raw) - 1 AS section_no
  FROM s JOIN paths p ON p.doc_id = s.doc_id AND p.raw = s.raw WHERE kind <> 'heading'
)"""
_SYNC = """m AS (SELECT *, nullif(trim(sha256), '') AS known FROM manifest), landed AS (
  SELECT doc_id, CASE WHEN (length(title) + length(source_url)) % 5 = 0 THEN sha256(title) ELSE coalesce(nullif(sha256, ''), sha256(title)) END AS now FROM manifest WHERE length(title) % 7 <> 0
), st AS (
  SELECT m.doc_id, CASE WHEN now IS NULL THEN 'failed: not landed' WHEN known IS NULL THEN 'new' WHEN known = now THEN 'unchanged' ELSE 'changed' END AS status, coalesce(now, known) AS sha256
  FROM m LEFT JOIN landed USING (doc_id)
)"""
SQL: dict[str, str] = {
    "body_size_mode": f"WITH {_B} SELECT doc_id, size AS body_size FROM (SELECT doc_id, size, sum(length(text)) AS n FROM b WHERE kind <> 'table' AND size IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC) = 1",
    "heading_flags": f"""WITH {_B}, z AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, sum(length(text)) AS n FROM b WHERE kind <> 'table' AND size IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC) = 1)
      SELECT block_id, coalesce(kind <> 'table' AND length(text) <= 150 AND len(string_split(text, chr(10))) <= 2 AND (coalesce(size >= body * 1.15, false) OR coalesce(bold, false) OR regexp_matches(text, '(?i)^(CHAPTER|PART|SCHEDULE|ANNEXURE|APPENDIX|STAGE)\\b')
        OR (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 4 AND upper(text) = text AND lower(text) <> text) OR (regexp_matches(text, '^(\\d+(\\.\\d+)*\\.?|[IVX]+\\.)\\s+\\S') AND NOT regexp_matches(text, '[.;,:]$'))), false) AS heading
      FROM b LEFT JOIN z USING (doc_id)""",
    "heading_levels": f"WITH {_B} SELECT block_id, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC NULLS LAST), 3) AS level_by_size FROM b WHERE kind = 'heading'",
    "outline": f"WITH {_B} SELECT doc_id, block_no, concat(repeat('  ', coalesce(level, 1) - 1), '- ', text) AS line FROM b WHERE kind = 'heading'",
    "pages_for_ocr": f"WITH {_B} SELECT doc_id, page, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM b GROUP BY ALL HAVING sum(length(trim(text))) < 300",
    "clean_prose": f"WITH {_B} SELECT block_id, trim(regexp_replace(regexp_replace(text, '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '[\\t-\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM b WHERE kind <> 'table'",
    "fix_glyphs": f"WITH {_B} SELECT block_id, regexp_replace(regexp_replace(text, 'μ(g\\s*/\\s*m)', 'µ\\1', 'g'), 'μ(m\\b)', 'µ\\1', 'g') AS text FROM b",
    "boilerplate_dropped": f"""WITH {_B}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM b),
      p AS (SELECT doc_id, count(DISTINCT page) AS n FROM k GROUP BY 1), o AS (SELECT doc_id, key, count(DISTINCT page) AS c FROM k WHERE kind <> 'table' GROUP BY ALL)
      SELECT block_id FROM k JOIN p USING (doc_id) LEFT JOIN o USING (doc_id, key)
      WHERE NOT (kind <> 'table' AND (regexp_matches(text, '(?i)^[^\\p{{L}}\\p{{M}}\\p{{N}}_]*(page\\s*)?\\d+(\\s*(of|/)\\s*\\d+)?[^\\p{{L}}\\p{{M}}\\p{{N}}_]*$') OR (coalesce(c, 0) >= greatest(2, ceil(0.5 * n)) AND length(text) <= 200)))""",
    "heading_paths": f"WITH {SECTIONS_SQL} SELECT block_id, section_no, heading_path FROM body",
    "structure_parents": f"""WITH {SECTIONS_SQL}, w AS (SELECT doc_id, section_no, heading_path, CASE WHEN heading_path <> '' THEN heading_path || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY block_no) AS whole FROM body GROUP BY doc_id, section_no, heading_path)
      SELECT concat(doc_id, '::s', lpad(CAST(section_no AS VARCHAR), 3, '0')) AS parent_id, heading_path, length(whole) AS chars, CAST(len(regexp_extract_all(whole, '[^\\t-\\r \\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+')) AS INT) AS token_count FROM w""",
    "fixed_chunks": f"""WITH {_B}, w AS (SELECT doc_id, block_no, page, list_filter(regexp_split_to_array(text, '[\\t-\\r \\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS ws FROM b),
      f AS (SELECT *, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY block_no) - len(ws) AS first, sum(len(ws)) OVER (PARTITION BY doc_id) AS total FROM w WHERE len(ws) > 0),
      e AS (SELECT doc_id, page, block_no, total, first + k - 1 AS i, ws[k] AS x FROM (SELECT *, unnest(generate_series(1, len(ws))) AS k FROM f)),
      c AS (SELECT doc_id, unnest(generate_series(0, CAST(greatest(ceil((total - 500) / 450.0), 0) AS BIGINT))) AS c FROM (SELECT DISTINCT doc_id, total FROM f))
      SELECT concat(c.doc_id, '::fixed::c', lpad(CAST(c AS VARCHAR), 3, '0')) AS chunk_id, c.doc_id, string_agg(x, ' ' ORDER BY i) AS text, min_by(page, i) AS page_start, max_by(page, i) AS page_end, CAST(count(*) AS INT) AS token_count
      FROM c JOIN e ON e.doc_id = c.doc_id AND i >= c * 450 AND i < c * 450 + 500 GROUP BY c.doc_id, c""",
    "chunk_stats": "SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS docs, round(avg(token_count), 6) AS mean_tokens, max(token_count) AS max_tokens FROM chunks",
    "chunk_metadata": "SELECT chunk_id, title, coalesce(is_current, '') = 'true' AS is_current, try_cast(nullif(trim(published_on), '') AS DATE) AS published_on, array_to_string(list_filter(string_split(coalesce(cities, ''), ';'), lambda x: x <> ''), ';') AS cities FROM chunks LEFT JOIN manifest USING (doc_id)",
    "metadata_filter": "SELECT doc_id FROM manifest WHERE is_current = 'true' AND doc_type IN ('act', 'order', 'circular') AND language = 'en'",
    "manifest_sync_status": f"WITH {_SYNC} SELECT * FROM st",
    "sync_histogram": f"WITH {_SYNC} SELECT split_part(status, ':', 1) AS status, count(*) AS n FROM st GROUP BY 1",
    "unparsed_documents": "SELECT doc_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM manifest p WHERE p.is_current = 'true' AND p.doc_id = m.doc_id AND p.sha256 = m.sha256)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        body_size_mode, heading_flags, heading_levels, outline, pages_for_ocr, clean_prose, clean_table, fix_glyphs, boilerplate_dropped, clean_documents,
        heading_paths, structure_parents, structure_chunks, structure_chunks_small, fixed_chunks, chunk_stats, chunk_metadata, metadata_filter,
        manifest_sync_status, sync_histogram, unparsed_documents,
    )
}
