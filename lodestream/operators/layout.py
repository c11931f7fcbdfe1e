"""From extracted spans and cells to blocks. The extraction itself (PDF, OCR) is an adapter outside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(box: Column, rect: Column) -> Column:
    """Whether the centre of a box lies in a rectangle; both are structs of x0, y0, x1, y1."""
    cx, cy = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return cx.between(rect["x0"], rect["x1"]) & cy.between(rect["y0"], rect["y1"])


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Text blocks from spans (doc_id, page, box_no, line_no, span_no, text, size, bold, ocr).

    Lines are joined by line ends; the size is the one of most characters, rounded to a tenth; bold where all
    spans are. Blank spans count nothing, a box without text is no block.
    """
    s = spans.where(F.trim("text") != "")
    key = ["doc_id", "page", "box_no"]
    lines = s.groupBy(*key, "line_no").agg(F.array_sort(F.collect_list(F.struct("span_no", "text"))).alias("ss"))
    lines = lines.select(*key, "line_no", F.trim(F.array_join("ss.text", "")).alias("line"))
    text = lines.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    size = s.groupBy(*key, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    size = size.groupBy(*key).agg(F.max_by("size", F.struct("n", "size")).alias("size"))
    flags = s.groupBy(*key).agg(F.every(F.coalesce("bold", F.lit(False))).alias("bold"), F.some(F.coalesce("ocr", F.lit(False))).alias("ocr"))
    return text.join(size, key).join(flags, key)


def without_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, box) whose centre lies in no table (doc_id, page, rect) of their page."""
    per_page = tables.groupBy("doc_id", "page").agg(F.collect_list("rect").alias("rects"))
    j = blocks.join(per_page, ["doc_id", "page"], "left")
    return j.where(~F.coalesce(F.exists("rects", lambda r: inside(F.col("box"), r)), F.lit(False))).drop("rects")


def table_markdown(cells: DataFrame) -> DataFrame:
    """Tables of two rows and two columns at least as markdown: doc_id, page, table_no, text. ``cells``: these and row, col, text."""
    key = ["doc_id", "page", "table_no"]
    rows = cells.groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("cs"))
    line = F.concat(F.lit("|"), F.array_join("cs.text", "|"), F.lit("|"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("cs")))
    per = rows.select(*key, "row", line.alias("line"), rule.alias("rule"), F.size("cs").alias("wide"))
    t = per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "line", "rule"))).alias("ls"), F.max("wide").alias("wide"))
    t = t.where((F.size("ls") >= 2) & (F.col("wide") >= 2))
    head = F.array(F.col("ls")[0]["line"], F.col("ls")[0]["rule"])
    return t.select(*key, F.array_join(F.concat(head, F.slice(F.col("ls.line"), 2, F.size("ls"))), "\n").alias("text"))


def point_id(key: Column) -> Column:
    """The name-based UUID (version 5, URL namespace) of a key, so that writing a row again writes the same row."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(key, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab89ab89ab89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
