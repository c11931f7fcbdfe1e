"""Cleaning, headings and chunking on small literal documents."""

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import documents as D
from lodestream.operators import layout

BLOCK = "doc_id string, page int, block_no int, kind string, level int, text string, size double, bold boolean, ocr boolean"


def blocks(spark, rows):
    """Rows of (kind, level, text[, page])."""
    return spark.createDataFrame([("d", (r[3] if len(r) > 3 else 1), k, r[0], r[1], r[2], 10.0, False, False) for k, r in enumerate(rows)], BLOCK)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first().o


@pytest.mark.parametrize(
    ("raw", "out"),
    [("60 g/m3", "60 µg/m3"), (" point", "• point"), ("ab", "ab"), ("μg/m³ of μ", "µg/m³ of μ"), ("", ""), (None, None)],
)
def test_glyphs(spark, raw, out):
    assert one(spark, raw, X.fix_glyphs) == out


def test_prose(spark):
    assert one(spark, " imple-\nmentation of Stage-\nIII  rules\n", X.clean_prose) == "implementation of Stage- III rules"
    assert one(spark, "café", lambda c: X.clean_text(c, F.lit("text"))) == "café"
    assert one(spark, "", X.clean_prose) == ""


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("|A|Col2|B<br>C|\n|---|---|---|\n|**x**|x|80|\n|x|x|80|\n||||\n|80|80|y|", "|A||B C|\n|---|---|---|\n|x||80|\n|80|80|y|"),
        ("|h|\n|---|\n|1|\n|1|\n|2|", "|h|\n|---|\n|1|\n|2|"),
        ("|Name|Name|Name|\n|:---|---:|:--:|\n|a  b|a b|c|", "|Name|||\n|:---|---:|:--:|\n|a b||c|"),
        ("|only|", "|only|"),
    ],
)
def test_tables(spark, raw, want):
    assert one(spark, raw, X.clean_table) == want


def test_boilerplate_needs_half_of_the_pages(spark):
    rows = [("text", None, x, p) for p in range(1, 5) for x in (f"Board Circular {p}", f"Page {p} of 4", f"Own paragraph {'abcd'[p - 1]}", "Same long text " * 20)]
    kept = D.drop_boilerplate(blocks(spark, [*rows, ("table", None, "7", 1)])).collect()
    assert sorted({r.text[:8] for r in kept}) == ["7", "Own para", "Same lon"]
    assert D.clean_blocks(blocks(spark, [("text", None, "."), ("text", None, "ab"), ("text", None, "अब")])).count() == 2


@pytest.mark.parametrize(
    ("text", "size", "bold", "want"),
    [
        ("Anything", 11.5, False, True), ("Anything", 11.4, False, False), ("Anything", 10.0, True, True), ("Annexure 4", 10.0, False, True),
        ("STAGE MEASURES", 10.0, False, True), ("AQI", 10.0, False, False), ("3.2 Actions", 10.0, False, True), ("3.2 Actions.", 10.0, False, False),
        ("IV. Stage", None, None, True), ("x" * 151, 20.0, True, False), ("a\nb\nc", 20.0, True, False),
    ],
)
def test_headings(spark, text, size, bold, want):
    df = spark.createDataFrame([(text, size, bold, 10.0)], "t string, s double, b boolean, y double")
    assert df.select(D.is_heading(F.col("t"), F.col("s"), F.col("b"), F.col("y")).alias("h")).first().h is want


def test_sections_follow_the_heading_stack(spark):
    b = blocks(spark, [("text", None, "intro"), ("heading", 1, "A"), ("heading", 2, "B"), ("text", None, "x"), ("heading", 2, "C  c"), ("text", None, "y"), ("heading", 1, "D"), ("heading", 3, "E"), ("text", None, "z")])
    got = [(r.text, r.section_no, r.heading_path) for r in D.sections(b).orderBy("block_no").collect()]
    assert got == [("intro", 0, ""), ("x", 1, "A › B"), ("y", 2, "A › C c"), ("z", 3, "D › E")]
    assert [r.text for r in D.parents(b).orderBy("parent_id").collect()] == ["intro", "A › B\nx", "A › C c\ny", "D › E\nz"]


def test_fixed_windows(spark):
    words = " ".join(f"w{k}" for k in range(230))
    rows = [("1", 1, 0, words), ("2", 1, 0, ""), ("3", 1, 0, None), ("4", 2, 0, " one\u00a0two "), ("5", 1, 0, " ".join("x" * 100)), ("6", 1, 0, "a  b\nc"), ("6", 2, 1, " "), ("6", 2, 2, "d e f g"), ("6", 3, 3, "h")]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_no int, text string")
    got = sorted(D.fixed_windows(df, 100, 20).collect(), key=lambda r: r.chunk_id)
    assert got[0].asDict().keys() == dict.fromkeys(D.CHUNK.names).keys()
    assert [(r.chunk_id, r.token_count) for r in got] == [("1::fixed::c000", 100), ("1::fixed::c001", 100), ("1::fixed::c002", 70), ("4::fixed::c000", 2), ("5::fixed::c000", 100), ("6::fixed::c000", 8)]
    assert got[-1].text == "a  b\nc\n\nd e f g\n\nh" and (got[-1].page_start, got[-1].page_end) == (1, 3) and got[3].text == "one\u00a0two"
    small = sorted(D.fixed_windows(df.where("doc_id = '6'"), 4, 2).collect(), key=lambda r: r.chunk_id)
    assert [(r.text, r.page_start, r.page_end, r.token_count) for r in small] == [("a  b\nc\n\nd", 1, 2, 4), ("c\n\nd e f", 1, 2, 4), ("e f g\n\nh", 2, 3, 4)]
    with pytest.raises(ValueError):
        D.fixed_windows(df, 20, 20)


def test_structure_chunks_keep_tables_and_overlap_prose(spark):
    table = "|h|k|\n|---|---|\n" + "\n".join(f"|r{k} a b|c d|" for k in range(4))
    prose = " ".join(f"Sentence {k} has five words." for k in range(12))
    b = blocks(spark, [("heading", 1, "Plan"), ("heading", 2, "Stage"), ("text", None, "short text"), ("table", None, table), ("heading", 2, "Long"), ("text", None, prose)])
    whole = D.structure_chunks(b, most=60, overlap=6).collect()
    assert all(r.token_count <= 60 for r in whole) and any(table in r.text for r in whole)
    small = sorted(D.structure_chunks(b, most=12, overlap=6).collect(), key=lambda r: r.chunk_id)
    tables = [r.text for r in small if "|" in r.text]
    assert len(tables) > 1 and all("|h|k|\n|---|---|\n|r" in t for t in tables)
    prose_parts = [r.text for r in small if r.heading_path == "Plan › Long"]
    assert all(set(a.split()[-4:]) & set(b.split()) for a, b in zip(prose_parts, prose_parts[1:]))
    assert all(r.embed_text == f"{r.heading_path}\n{r.text}" and r.chunk_id.startswith(r.parent_id) for r in small)


def test_packer_edges():
    p = D.Packer(most=5, overlap=2)
    assert p.units("a b c d e f g", "text") == [("a b c d e", False), ("f g", False)]
    assert p.units("|" + "w " * 9 + "|", "table")
    assert p.pack([]) == [] and p.tail("") == ""
    assert p.by_rows("|h|\n|1|") == ["|h|\n|1|"]


def test_spans_and_tables(spark):
    spans = spark.createDataFrame([("d", 1, 0, 0, 0, "Big", 14.02, True, False), ("d", 1, 0, 0, 1, " title", 14.0, True, False), ("d", 1, 0, 1, 0, "x", 9.0, False, None), ("d", 1, 1, 0, 0, "  ", 9.0, True, False)], "doc_id string, page int, box_no int, line_no int, span_no int, text string, size double, bold boolean, ocr boolean")
    got = layout.blocks_from_spans(spans).collect()
    assert [(r.text, r.size, r.bold, r.ocr) for r in got] == [("Big title\nx", 14.0, False, False)]
    cells = spark.createDataFrame([("d", 1, 0, r, c, f"{r}{c}") for r in range(2) for c in range(2)] + [("d", 1, 1, 0, 0, "lone")], "doc_id string, page int, table_no int, row int, col int, text string")
    assert [r.text for r in layout.table_markdown(cells).collect()] == ["|00|01|\n|---|---|\n|10|11|"]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    b = spark.createDataFrame([("d", 1, (0.0, 0.0, 2.0, 2.0)), ("d", 1, (8.0, 8.0, 9.0, 9.0)), ("d", 2, (0.0, 0.0, 1.0, 1.0))], f"doc_id string, page int, box {box}")
    t = spark.createDataFrame([("d", 1, (0.0, 0.0, 5.0, 5.0))], f"doc_id string, page int, rect {box}")
    assert layout.without_tables(b, t).count() == 2


def test_point_id(spark):
    import uuid

    keys = ["act::c001", "", "ज़"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.u for r in df.select(layout.point_id(F.col("k")).alias("u")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]
