"""Queries over the text tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import canonical, leaks, lookalike, scanned, subjects, tokens
from lodestream.runtime import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "parsed_blocks").select(F.lit("parsed_blocks").alias("tbl"), F.col("block_id").alias("id"), "text")
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text")
    return lookalike.look_alike_pairs(spread(blocks.unionByName(chunks)), "id", "text", ["tbl"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.defects(spread(table(spark, d, "parsed_blocks")))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanned.paragraphs(spread(table(spark, d, "parsed_blocks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "city_reference")
    rows = table(spark, d, "city_aqi_daily").select("row_id", "city").where(F.col("city").isNotNull())
    free = rows.join(ref.select("city").distinct(), "city", "left_anti")
    return canonical.map_values(free, "row_id", "city", ref, "city_id", ("city", "name_hi", "former_name")).select("row_id", F.col("entry").alias("city_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = subjects.subject_areas(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))
    return found.select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p4_found": p4_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
SQL: dict[str, str] = {}
