import pytest

from lodestream.llm import scanned as S

SCHEMA = "block_id string, doc_id string, page int, block_no int, kind string, text string, size double, ocr boolean, line string"
BODY = [
    "The district office measured smog and a report reached the board.", "No one could explain the low-cost sensor or the report of the board.",
    "Under the rules the district office must report smog in days.", "A low-cost sensor measured the complaints about smog.",
]


def rows(scan):
    """Eight digital documents for the vocabulary, and one scanned document."""
    out = [(f"v{n}b{k}", f"v{n}", 1, k, "text", t, 10.0, False) for n in range(8) for k, t in enumerate(BODY)]
    return [(*r, "clash") for r in out + [(f"s{k}", "s", p, k, kind, t, size, ocr) for k, (p, kind, t, size, ocr) in enumerate(scan)]]


SCAN = [
    (1, "text", "State Board Circular 7 1", 8.0, True), (1, "text", "The dis-\ntrict office measured smog.", 10.0, True), (1, "text", "The low-\ncost sensor measured srnog.", None, True),
    (1, "text", "No one could explain the\nPage 4 of 9\nreport of the board.", 10.0, True), (1, "text", "A rep0rt about complaints reached the dist-", None, True), (1, "text", "- 1 -", None, True),
    (2, "text", "State Boarcl Circular 7 2", None, True), (2, "text", "rict office in days.", 10.0, True), (2, "text", "The board measured smog in days.", 10.0, True),
    (2, "text", "The rnles", 10.0, False), (3, "text", "State Board Circular 7 3", None, True), (3, "text", None, 10.0, True), (3, "text", "", 10.0, True),
    (3, "heading", "Annexure 4", 14.0, True), (3, "text", "The office meas¬\nured smog", None, True), (3, "text", "a¬", None, True), (4, "text", "The cofnplaints reach-", None, None),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(rows(SCAN) + [(None, "s", 1, 99, "text", "1", 8.0, True, "x")], SCHEMA)


def test_defects(blocks):
    got = {}
    for r in S.defects(blocks).collect():
        got.setdefault(r.block_id, set()).add(r.defect)
    assert got == {
        "s0": {"furniture"}, "s1": {"hyphen"}, "s2": {"misread"}, "s3": {"furniture"}, "s4": {"hyphen", "misread"}, "s5": {"furniture"}, "s6": {"furniture"},
        "s10": {"furniture"}, "s14": {"hyphen"}, "s15": {"hyphen"},
    }


def test_paragraphs(blocks):
    texts = [r.text for r in S.paragraphs(blocks.where("doc_id = 's' OR doc_id LIKE 'v%'")).where("doc_id = 's'").orderBy("para_no").collect()]
    assert "The district office measured smog." in texts and "The low-cost sensor measured smog." in texts
    assert "No one could explain the report of the board." in texts
    assert "A report about complaints reached the district office in days." in texts
    assert "Annexure 4" in texts and not any("Circular" in t or "Page" in t for t in texts)


def test_skeleton_and_confusions():
    c = S.Confusable()
    for read, true in (("rnonitor", "monitor"), ("clrifts", "drifts"), ("utihsation", "utilisation"), ("plari", "plan"), ("iincertain", "uncertain"), ("vvinter", "winter"), ("c0nte5t", "contest")):
        assert S.skeleton(read) == S.skeleton(true) and 0 < c.count(read, true, 2) <= 2
    assert c.count("same", "same", 2) == 0 and c.count("board", "report", 2) == 3 and c.count("", "", 2) == 0


def test_edges(spark, blocks):
    assert S.defects(blocks.where("block_id = 'none'")).count() == 0
    assert S.paragraphs(blocks.where("block_id = 'none'")).count() == 0
    long = spark.createDataFrame([("x", "d", 1, 0, "text", "word " * 100_000, None, True, "x"), ("x", "d", 1, 0, "text", "word " * 100_000, None, True, "x"), ("y", None, None, None, "text", "1", None, True, "x")], SCHEMA)
    assert {(r.block_id, r.defect) for r in S.defects(long).collect()} == {("y", "furniture")}


def test_shards_and_repeats_change_nothing(spark, blocks, monkeypatch):
    as_set = lambda df: {tuple(r) for r in df.collect()}
    want = as_set(S.defects(blocks)), as_set(S.paragraphs(blocks))
    monkeypatch.setattr(S, "SHARD", 2)
    twice = blocks.unionByName(blocks.where("doc_id = 's'")).unionByName(blocks.where("block_id = 's1'"))
    assert (as_set(S.defects(twice)), as_set(S.paragraphs(twice))) == want


def test_page_numbers_at_the_ends_of_blocks(spark):
    texts = [
        (1, "The board measured smog\n[ 4 ]"), (1, "Page 4 of 9\nThe office must report"), (2, "The board measured smog in\n- 5 -"), (2, "No smog in\n77"),
        (4, "The board measured smog\n6"), (5, "7\nThe board measured smog"), (6, "The board measured smog\n8"), (7, "9\nThe board measured smog\nin"), (8, "The office\n3"),
    ]
    b = spark.createDataFrame(rows([(p, "text", t, 10.0, True) for p, t in texts]), SCHEMA)
    got = {(r.block_id, r.line) for r in S.own_lines(b).where("furniture").collect()}
    assert got == {("s0", "[ 4 ]"), ("s1", "Page 4 of 9"), ("s2", "- 5 -"), ("s4", "6"), ("s5", "7"), ("s6", "8"), ("s7", "9")}
    assert not any("Page" in r.text or "[" in r.text for r in S.paragraphs(b).where("doc_id = 's'").collect())


def fixed(spark, lines, digital=()):
    """What becomes of scanned lines beside digital ones: the scanned texts."""
    b = [(f"v{k}", f"v{k}", 1, 0, "text", t, 10.0, False, "x") for k, t in enumerate(digital)] + [(f"s{k:03d}", f"s{k}", 1, 0, "text", t, 10.0, True, "x") for k, t in enumerate(lines)]
    df = spark.createDataFrame(b, SCHEMA)
    return [r.text for r in S.paragraphs(df).where("doc_id LIKE 's%'").orderBy("first_block").collect()], {r.block_id for r in S.defects(df).where("defect = 'misread'").collect()}


def test_decades_units_and_formulas_stay(spark):
    line = "In the 90s and the 1990s rose by 5s per unit and 10b more, with so2 and b12."
    texts, found = fixed(spark, [line] + ["Boxes 905, 55 and 108 were seen."] * 9)
    assert texts[0] == line and not found
    line = "It rose in the 80s near the gate."
    texts, found = fixed(spark, [line], ["It rose in the 805 near the gate.", "A look at the 60s shows more."] * 10)
    assert texts == [line] and not found


def test_numbers_with_letters_for_digits_are_mended_where_supported(spark):
    texts, found = fixed(spark, ["It rose by l7 per cent in 2o25 at the gate.", "About l7 of them."], [f"It rose by {k} per cent in 20{k} at the gate." for k in range(18, 30)])
    assert texts == ["It rose by 17 per cent in 2025 at the gate.", "About l7 of them."] and found == {"s000"}


# Pairs of true words of one skeleton, the second the rarer one, each beside words of its own.
REAL = [("modern", "modem"), ("dear", "clear"), ("burn", "bum"), ("corn", "com"), ("form", "farm"), ("hand", "band"), ("cat", "oat"), ("head", "bead"), ("cone", "cane"), ("fire", "tire")]


def test_real_words_that_can_be_confused_stay(spark):
    often = [f"The {a} thing of the town number {k}." for a, _ in REAL for k in range(12)]
    rare = [f"Plug the {b} into the wall." for _, b in REAL]
    texts, found = fixed(spark, often + rare)
    assert texts[len(often) :] == rare and not found
    misread = [f"The {b} thing of the town." for _, b in REAL]
    texts, found = fixed(spark, often + misread)
    assert len(found) >= 8 and len(set(misread) & set(texts)) == len(misread) - len(found)
