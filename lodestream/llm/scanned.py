"""Repair of text from scanned pages: page furniture, words broken across lines, misread characters, reflow.

Lines of all blocks are put in reading order. Furniture is found by masking digits: short texts of one form
on several pages of a document, in small print, or in the form of a page number; the forms found then
also give away furniture lines inside other blocks. Windows over the reading order bring each line and the
next line of the document's own text together, which shows words broken at line and page ends; whether a
hyphen is the word's own is decided by how often the joined and the hyphenated form stand within lines.

Misread words are found among words of one confusable-glyph skeleton (a form in which glyphs that scanners
mix up are alike): a rare form that can come from a frequent one by few confusions, and that digital pages
don't support, is a misreading of it. Of several such forms the one that stands most often beside the same
neighbours is taken, then the most frequent.

Expected columns: block_id, doc_id, page, block_no, kind, text, size, ocr; others are ignored. Blocks with a
null id or text are left out; null sizes say nothing; a null ocr is no scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.runtime import durable, small

# What scanners read, and what stood there.
CONFUSIONS = """
rn m|m rn|in m|m in|ni m|cl d|d cl|ri n|n ri|ii u|u ii|n u|u n|vv w|w vv|h li|li h|h b|b h|c e|e c|o a|a o|o e|e o
0 o|o 0|1 l|l 1|1 i|i 1|l i|i l|t f|f t|5 s|s 5|9 g|g 9|4 a|a 4|8 b|b 8|6 b|b 6|q g|g q|y v|v y|j i|i j|! l|r i
"""
# The glyphs of the skeleton, stroke by stroke.
STROKES = {"m": "iii", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "d": "oi", "w": "vv", "y": "v", "g": "q", "9": "q",
           "l": "i", "1": "i", "r": "i", "j": "i", "a": "o", "c": "o", "e": "o", "0": "o", "4": "o", "f": "t", "5": "s"}

WORD = r"[\p{L}\p{M}\p{N}]+"
LETTERS = r"[\p{L}\p{M}]+"
# A word, misread letters included, of which a letter is left.
LETTERED = r"(?=\p{N}*\p{L})[\p{L}\p{M}\p{N}]+"
HYPHENS = "-‐‑¬­"
# A number of which digits may be read as letters, and the forms of page numbers.
NUMBER = r"(?:[\dlIOo]*\d[\dlIOo]*|[lI])"
PAGE_NUMBER = rf"(?i)^\s*(?:{NUMBER}|[ivxl]+|\[\s*{NUMBER}\s*\]|[-–—]\s*{NUMBER}\s*[-–—]|p\w{{3}}\s+{NUMBER}(?:\s+of\s+{NUMBER})?|{NUMBER}\s*(?:/|of)\s*{NUMBER}|{NUMBER}\s*\|\s*\w\s?\w\s?\w\s?\w)\s*$"
# Of these the forms that are page numbers wherever they stand.
SURE_NUMBER = rf"(?i)^\s*(?:\[\s*{NUMBER}\s*\]|[-–—]\s*{NUMBER}\s*[-–—]|p\w{{3}}\s+{NUMBER}(?:\s+of\s+{NUMBER})?)\s*$"
# A whole number of digits and letters read for digits.
NUMERIC = r"^(?=.*\p{Nd})[0-9loisb]+$"
# The parts of words that a line end may have cut.
CUT_END, CUT_START = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){LETTERED}[{HYPHENS}][\s]*$", rf"^\s*{LETTERED}"
#: Stands between a joined word and what is known of it.
MARK = "\u0001"
INVISIBLE = "[\\u200b-\\u200f\\u2060\\ufeff]"
SENTENCE_END = r"[.!?।;:,]['\")\]»”]*\s*$"
#: Candidates for misreadings that are looked up from a list in each task; more are joined.
LOOKED_UP = 200_000
#: Blocks of a document whose lines are put in order together.
SHARD = 512
#: Groups of skeletons at least, and words of a group about at most.
SLOTS, SLOT_WORDS = 256, 50_000


@dataclass(frozen=True)
class Limits:
    """pages: pages of a document that show a header's form; documents: documents that make a form known everywhere;
    small: share of the body size below which print is small; rarer: times a form must be rarer than what it is
    taken for; running: pages whose bare numbers at the ends of blocks must count on with the pages; firm: the same where digital pages have the form too; confusions: most of one word."""

    pages: int = 2
    documents: int = 3
    small: float = 0.9
    rarer: int = 8
    running: int = 3
    firm: int = 200
    confusions: int = 2
    longest: int = 200


def skeleton(word: str) -> str:
    """The word with confusable glyphs alike."""
    return "".join(STROKES.get(ch, ch) for ch in word.lower())


class Confusable:
    """How many confusions turn a form into what was read."""

    def __init__(self):
        pairs = [x.split() for line in CONFUSIONS.split("\n") for x in line.split("|") if x.strip()]
        self.by_first: dict[str, list[tuple[str, str]]] = {}
        for read, true in pairs:
            self.by_first.setdefault(read[0], []).append((read, true))

    def count(self, read: str, true: str, most: int) -> int:
        """The fewest confusions, or most + 1."""
        n, m = len(read), len(true)
        best = {(0, 0): 0}
        for i in range(n):
            for j in [j for a, j in list(best) if a == i]:
                d = best[i, j]
                if j < m and read[i] == true[j] and best.get((i + 1, j + 1), most + 1) > d:
                    best[i + 1, j + 1] = d
                if d < most:
                    for a, b in self.by_first.get(read[i], ()):
                        if read.startswith(a, i) and true.startswith(b, j):
                            to = (i + len(a), j + len(b))
                            if best.get(to, most + 1) > d + 1:
                                best[to] = d + 1
        return best.get((n, m), most + 1)


def _glyphs(c: Column) -> Column:
    """The skeleton of a lower-case column, as ``skeleton`` gives it."""
    for glyph, strokes in STROKES.items():
        if len(strokes) > 1:
            c = F.replace(c, F.lit(glyph), F.lit(strokes))
    flat = [(g, s) for g, s in STROKES.items() if len(s) == 1]
    return F.translate(c, "".join(g for g, _ in flat), "".join(s for _, s in flat))


def _masked(name: str) -> Column:
    """Numbers and roman numerals masked, those at the end taken off, and the skeleton of the rest."""
    c = F.regexp_replace(F.lower(F.trim(F.col(name))), r"(?<![\p{L}\p{N}])(?:[\p{N}lio]*\p{N}[\p{N}lio]*|[ivxl]{1,6})(?![\p{L}\p{N}])", "#")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"(?: ?#)+$", "")
    return _glyphs(c)


def _template(name: str) -> Column:
    """The masked form with capitalised words alike, so that headers naming different bodies are of one form."""
    c = F.regexp_replace(F.trim(F.col(name)), r"(?<![\p{L}\p{N}])[\p{N}lIOo]*\p{N}[\p{N}lIOo]*(?![\p{L}\p{N}])", "#")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}])(?:\p{Lu}|\p{N}(?=\p{L}))[\p{L}\p{M}\p{N}]*", "@")
    c = F.regexp_replace(F.regexp_replace(c, r"\p{N}+", "#"), r"\s+", " ")
    return F.regexp_replace(c, r"(?: ?#)+$", "")


def own_lines(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All lines in reading order, with what they are.

    Columns: doc_id, block_id, block_no, kind, ocr, at (line of the block), line, whole (the block is
    furniture), furniture (the line is), and for lines of the document's own running text: tail (letters
    before a hyphen at the line's end), mark (that hyphen), head (letters at the start of the next such
    line), next_block and next_at (where that line is), last_head (whether the line before ends in a hyphen).
    """
    b = blocks.select("doc_id", "block_id", "block_no", "page", "kind", "text", "size", F.coalesce("ocr", F.lit(False)).alias("ocr"))
    b = b.dropna(subset=["block_id", "text"]).dropDuplicates().withColumn("text", F.regexp_replace("text", INVISIBLE, ""))
    chars = F.length("text")
    single = (F.col("kind") == "text") & ~F.trim("text").contains("\n") & (chars <= limits.longest)
    b = durable(b.withColumn("single", single).withColumn("form", F.when(F.col("single"), _masked("text"))))
    sizes = b.where("kind = 'text' AND size IS NOT NULL").groupBy("doc_id", "size").agg(F.sum(chars).alias("chars"))
    sizes = durable(sizes)
    body = small(durable(sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", "size")).alias("body")).dropna()))
    usual = sizes.groupBy("size").agg(F.sum("chars").alias("chars")).agg(F.max_by("size", F.struct("chars", "size")).alias("usual"))
    headers = b.where(F.col("single") & ~F.col("text").rlike(SENTENCE_END)).groupBy("doc_id", "form").agg(F.countDistinct("page").alias("pages"))
    headers = small(durable(headers.where(F.col("pages") >= limits.pages).select(F.col("doc_id").alias("h_doc"), F.col("form").alias("h_form"))))
    b = b.join(body, "doc_id", "left").crossJoin(usual)  # one row
    b = b.join(headers, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("form") == F.col("h_form")), "left")
    tiny = F.col("size") < limits.small * F.greatest(F.coalesce("body", "usual"), F.col("usual"))
    whole = F.col("single") & (F.col("text").rlike(PAGE_NUMBER) | F.coalesce(tiny, F.lit(False)) | F.col("h_form").isNotNull())
    b = b.withColumn("whole", F.coalesce(whole, F.lit(False))).select("doc_id", "block_id", "block_no", "page", "kind", "ocr", "text", "form", "whole")

    found = durable(b.where("whole").withColumn("template", _template("text")).groupBy("doc_id", "form", "template").agg(F.count(F.lit(1)).alias("n")))
    local = small(durable(found.select(F.col("doc_id").alias("l_doc"), F.col("form").alias("l_form")).where("l_form <> ''").distinct()))
    known = found.where(F.length("template") > 3).groupBy("template").agg(F.countDistinct("doc_id").alias("n"))
    known = small(durable(known.where(F.col("n") >= limits.documents).select(F.col("template").alias("k_form"))))
    lines = b.select("doc_id", "block_id", "block_no", "page", "kind", "ocr", "whole", F.posexplode(F.split("text", "\n")).alias("at", "line"), F.size(F.split("text", "\n")).alias("of"))
    inner = (F.col("kind") == "text") & (F.col("of") > 1) & ~F.col("whole") & (F.length("line") <= limits.longest) & ~F.col("line").rlike(SENTENCE_END)
    lines = lines.withColumn("inner", F.coalesce(inner, F.lit(False)))
    inner = F.col("inner")
    lines = lines.withColumn("form", F.when(inner, _masked("line"))).withColumn("template", F.when(inner, _template("line")))
    lines = lines.join(local, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("form") == F.col("l_form")), "left")
    lines = lines.join(known, F.col("template") == F.col("k_form"), "left")
    # A bare number first or last in a block is one if numbers so placed count on with the pages.
    within = (F.col("at") > 0) & (F.col("at") < F.col("of") - 1)
    bare = F.when(inner & ~within & F.col("line").rlike(rf"^\s*{NUMBER}\s*$"), F.translate(F.trim("line"), "lIOo", "1100"))
    lines = lines.withColumn("ahead", F.when(F.length(bare) <= 5, bare.try_cast("int") - F.col("page")))
    numbered = inner & ((F.col("line").rlike(PAGE_NUMBER) & within) | F.col("line").rlike(SURE_NUMBER))
    furniture = F.col("whole") | numbered | F.col("l_form").isNotNull() | F.col("k_form").isNotNull()
    tail = F.regexp_extract("line", rf"(?<![\p{{L}}\p{{M}}\p{{N}}])({LETTERED})[{HYPHENS}][\s]*$", 1)
    lines = lines.withColumn("furniture", F.coalesce(furniture, F.lit(False)))
    cut = F.right(F.rtrim("line", F.lit(" \t\r\f\x0b")), F.lit(1)).isin(*HYPHENS)  # only then the pattern has to look
    lines = lines.withColumn("tail", F.when(cut, F.nullif(tail, F.lit("")))).withColumn("start", F.regexp_extract("line", rf"^\s*({LETTERED})", 1))
    lines = durable(lines.select("doc_id", "block_id", "block_no", "page", "kind", "ocr", "at", "line", "whole", "furniture", "ahead", "tail", "start"))
    counted = lines.where("ahead IS NOT NULL").groupBy("doc_id", "ahead").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= limits.running)
    counted = small(durable(counted.select(F.col("doc_id").alias("c_doc"), F.col("ahead").alias("c_ahead"))))
    lines = lines.join(counted, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("ahead") == F.col("c_ahead")), "left")
    lines = lines.withColumn("furniture", F.col("furniture") | F.col("c_ahead").isNotNull())

    running = (F.col("kind") == "text") & ~F.col("furniture") & (F.trim("line") != "")
    lines = lines.withColumn("running", running)
    text = lines.where("running").withColumn("begin", F.struct(F.col("start").alias("head"), "block_id", "at"))
    text = text.withColumn("shard", F.floor(F.coalesce("block_no", F.lit(0)) / SHARD)).withColumn("place", F.struct("block_no", "block_id", "at"))
    # The order of a long document is kept in shards; their first and last lines link them.
    long = small(durable(text.where("shard > 0").select(F.col("doc_id").alias("s_doc")).distinct()))
    links = text.join(long, F.col("doc_id").eqNullSafe(F.col("s_doc")), "left_semi").groupBy("doc_id", "shard").agg(F.min_by("begin", "place").alias("first"), F.max_by(F.col("tail").isNotNull(), "place").alias("open"))
    over = Window.partitionBy("doc_id").orderBy("shard")
    links = links.select(F.col("doc_id").alias("n_doc"), F.col("shard").alias("n_shard"), F.lead("first").over(over).alias("after"), F.lag("open").over(over).alias("before"))
    text = text.join(small(durable(links)), F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("shard") == F.col("n_shard")), "left")
    order = Window.partitionBy("doc_id", "shard").orderBy("place")
    following = F.coalesce(F.lead("begin").over(order), F.col("after"))
    text = text.withColumn("next", F.when(F.col("tail").isNotNull(), following))
    text = text.withColumn("last_head", F.coalesce(F.lag(F.col("tail").isNotNull()).over(order), F.col("before"), F.lit(False)))
    text = text.withColumn("mark", F.when(F.col("tail").isNotNull(), F.regexp_extract("line", rf"([{HYPHENS}])[\s]*$", 1)))
    kept = ["doc_id", "block_id", "block_no", "kind", "ocr", "at", "line", "whole", "furniture"]
    text = text.select(*kept, "tail", "mark", F.col("next.head").alias("head"), F.col("next.block_id").alias("next_block"), F.col("next.at").alias("next_at"), "last_head")
    rest = lines.where("NOT running").select(*kept, F.lit(False).alias("last_head"))
    return text.unionByName(rest, allowMissingColumns=True)


def _inside() -> Column:
    """The line without the parts of words that a line end may have cut."""
    c = F.when(F.col("tail").isNotNull(), F.regexp_replace("line", CUT_END, "")).otherwise(F.col("line"))
    return F.when(F.col("last_head"), F.regexp_replace(c, CUT_START, "")).otherwise(c)


def cut_words(lines: DataFrame) -> DataFrame:
    """Line ends with a hyphen: doc_id, block_id, at, next_block, next_at, tail, head, joined, broken (the hyphen isn't the word's own)."""
    inside = lines.where(~F.col("furniture")).select(F.lower(_inside()).alias("line"))
    words = inside.select(F.explode(F.regexp_extract_all("line", F.lit(rf"({WORD})"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = inside.select(F.explode(F.regexp_extract_all("line", F.lit(rf"(?<![\p{{L}}\p{{M}}])(?=({LETTERS}[-‐‑]{LETTERS}))"))).alias("w"))
    pairs = pairs.select(F.regexp_replace("w", "[‐‑]", "-").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ends = lines.where("tail IS NOT NULL").select("doc_id", "block_id", "at", "next_block", "next_at", "mark", F.lower("tail").alias("tail"), F.lower("head").alias("head"))
    none = F.coalesce("head", F.lit("")) == ""
    ends = ends.withColumn("joined", F.concat("tail", F.coalesce("head", F.lit("")))).withColumn("pair", F.concat("tail", F.lit("-"), F.coalesce("head", F.lit(""))))
    for name, source, key in (("n_joined", words, "joined"), ("n_tail", words, "tail"), ("n_head", words, "head"), ("n_pair", pairs, "pair")):
        ends = ends.join(source.select(F.col("w").alias(key), F.col("n").alias(name)), key, "left").fillna(0, [name])
    never = F.col("mark").isin("¬", "­")
    both = (F.col("n_tail") >= 3) & (F.col("n_head") >= 3)
    broken = never | (F.col("n_joined") > F.col("n_pair")) | ((F.col("n_joined") == F.col("n_pair")) & ~both)
    broken = F.when(none, never | (F.col("n_tail") < 3)).otherwise(broken)
    return ends.withColumn("broken", broken).select("doc_id", "block_id", "at", "next_block", "next_at", "tail", "head", "joined", "broken")


def _eaten(ends: DataFrame) -> DataFrame:
    """Lines whose first word went to the line before: block_id, at, eaten."""
    return ends.where("next_block IS NOT NULL").select(F.col("next_block").alias("block_id"), F.col("next_at").alias("at"), F.lit(True).alias("eaten")).distinct()


def own_words(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """Blocks of the documents' own text as words in small letters: block_id, ocr, ws. A word joined over a line's end carries,
    after ``MARK``, the length of its first part and the block that its second part is in."""
    own = lines.where(~F.col("furniture")).select("block_id", "ocr", "at", "line")
    marks = ends.where("broken").select("block_id", "at", F.concat_ws(MARK, "joined", F.length("tail").cast("string"), F.coalesce("next_block", F.lit(""))).alias("joined"))
    joined = own.join(small(marks), ["block_id", "at"], "left").join(small(_eaten(ends.where("broken"))), ["block_id", "at"], "left")
    text = F.when(F.col("joined").isNotNull(), F.regexp_replace("line", CUT_END, "")).otherwise(F.col("line"))
    text = F.when(F.col("eaten").isNotNull(), F.regexp_replace(text, CUT_START, "")).otherwise(text)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD})"))
    found = F.when(F.col("joined").isNotNull(), F.concat(found, F.array("joined"))).otherwise(found)
    whole = joined.groupBy("block_id", "ocr").agg(F.array_sort(F.collect_list(F.struct("at", found.alias("ws")))).alias("x"))
    return whole.select("block_id", "ocr", F.flatten("x.ws").alias("ws")).where("size(ws) > 0")


def _word(c: Column) -> Column:
    return F.substring_index(c, MARK, 1)


def occurrences(listed: DataFrame) -> DataFrame:
    """Each word of own_words with its neighbours: block_id, ocr, raw (with its mark), w, last, next."""
    n = F.size("ws")
    last, following = F.concat(F.array(F.lit(None)), F.slice("ws", 1, n - 1)), F.concat(F.slice("ws", 2, n), F.array(F.lit(None)))
    each = listed.select("block_id", "ocr", F.explode(F.arrays_zip(F.col("ws").alias("w"), last.alias("l"), following.alias("f"))).alias("x"))
    return each.select("block_id", "ocr", F.col("x.w").alias("raw"), _word(F.col("x.w")).alias("w"), _word(F.col("x.l")).alias("last"), _word(F.col("x.f")).alias("next"))


def _beside(c: Column) -> Column:
    """What a neighbour counts as: any number is one, and words that can be misread as one another are one."""
    return F.when(c.rlike(NUMERIC), "#").otherwise(_glyphs(c))


def candidates(listed: DataFrame, limits: Limits) -> DataFrame:
    """``w``, ``fix``, ``n`` (of the fix), ``d`` (confusions), ``sort`` (what the fix counts as): forms that can be misreadings of much
    more frequent forms of their skeleton, and numbers in which letters may stand for digits."""
    each = listed.select("ocr", F.explode("ws").alias("w")).select("ocr", _word(F.col("w")).alias("w"))
    counts = durable(each.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ocr")).alias("digital")))
    slots = max(SLOTS, counts.count() // SLOT_WORDS)
    slotted = counts.withColumn("slot", F.pmod(F.xxhash64(_glyphs(F.col("w"))), F.lit(slots)))

    def match(t: pa.Table) -> pa.Table:
        by_skeleton: dict[str, list[tuple[int, int, str]]] = {}
        for w, n, digital in zip(*(t.column(c).to_pylist() for c in ("w", "n", "digital"))):
            by_skeleton.setdefault(skeleton(w), []).append((n, digital, w))
        confusable, out = Confusable(), []
        for group in by_skeleton.values():
            group.sort(reverse=True)
            for n, digital, w in group[1:]:
                if w.isdigit():  # another number is no misreading
                    continue
                for n2, _, c in group:
                    if n2 < n * (limits.firm if digital else limits.rarer):
                        break
                    if c.isdigit():  # numbers are looked at by their shape
                        continue
                    d = confusable.count(w, c, limits.confusions)
                    if 0 < d <= limits.confusions:
                        out.append((w, c, n2, d))
        return pa.table({"w": pa.array([x[0] for x in out], pa.string()), "fix": pa.array([x[1] for x in out], pa.string()), "n": pa.array([x[2] for x in out], pa.int64()), "d": pa.array([x[3] for x in out], pa.int32())})

    words = slotted.groupBy("slot").applyInArrow(match, "w string, fix string, n long, d int").withColumn("sort", F.col("fix"))

    # Numbers: supported as a number, and not in a shape (a decade, a unit, a formula) that digital pages have too.
    shape = F.regexp_replace("w", r"\p{N}+", "#")
    mixed = counts.where(F.col("w").rlike(NUMERIC) & ~F.col("w").rlike(r"^\p{N}+$")).withColumn("shape", shape)
    printed = counts.where(F.col("w").rlike(r"\p{N}") & (F.col("digital") > 0) & F.col("w").rlike(r"\p{L}")).select(shape.alias("shape")).distinct()
    numbers = mixed.where("digital = 0").join(printed, "shape", "left_anti").select("w", "shape", F.translate("w", "loisb", "10158").alias("fix"))
    known = counts.where(F.col("w").rlike(r"^\p{N}+$")).select(F.col("w").alias("fix"), "n")
    numbers = numbers.join(known, "fix", "left").fillna(0, ["n"])
    # Letters behind digits are mostly units, those before them names: only for a number that is there elsewhere.
    numbers = numbers.where(~F.col("shape").rlike("^#[a-z]+$|^[a-km-z][a-z]*#$") | (F.col("n") > 0))
    numbers = numbers.select("w", "fix", "n", (F.length(F.regexp_replace("w", r"\p{N}", ""))).alias("d"), F.lit("#").alias("sort"))
    return words.unionByName(numbers)


def _looked_up(listed: DataFrame, asked: list[str], sorts: list[str]) -> DataFrame:
    """What occurrences gives of the words of two lists, found batch by batch: in scanned blocks those of ``asked`` (block_id, raw,
    w, last, next), and anywhere the counts of those of ``sorts`` (w, last, next, s; '#' stands for any number)."""
    names = ["block_id", "raw", "w", "last", "next", "s"]
    any_number = "#" in sorts

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, tell = pa.array(asked, pa.string()), pa.array(sorts, pa.string())
        for b in batches:
            ws = b.column("ws")
            raw, ends = ws.flatten().cast(pa.string()), ws.offsets.to_numpy()
            size = np.diff(ends)
            n = len(raw)
            if not n:
                continue
            marked = pc.match_substring(raw, MARK)
            at = pa.array(np.flatnonzero(marked.to_numpy(zero_copy_only=False)))
            plain = pc.list_element(pc.split_pattern(raw.take(at), MARK, max_splits=1), 0) if len(at) else None
            w = pc.replace_with_mask(raw, marked, plain) if plain is not None else raw
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            edge = np.cumsum(size)
            first[(edge - size)[size > 0]], last[edge[size > 0] - 1] = True, True
            place = np.arange(n)
            before = w.take(pa.array(np.maximum(place - 1, 0), mask=first))
            after = w.take(pa.array(np.minimum(place + 1, n - 1), mask=last))
            row = np.repeat(np.arange(b.num_rows), size)
            scanned = b.column("ocr").to_numpy(zero_copy_only=False)[row].astype(bool)
            hit = pa.array(np.flatnonzero(scanned & pc.is_in(w, value_set=ask).to_numpy(zero_copy_only=False)))
            if len(hit):
                cols = [b.column("block_id").take(pa.array(row[hit.to_numpy()])), raw.take(hit), w.take(hit), before.take(hit), after.take(hit), pa.array(np.ones(len(hit), np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            if any_number:
                w = pc.if_else(pc.match_substring_regex(w, r"^\pN+$"), "#", w)
            known = pc.is_in(w, value_set=tell)
            counted = pa.table({"w": w.filter(known), "last": before.filter(known), "next": after.filter(known)}).group_by(["w", "last", "next"]).aggregate([([], "count_all")])
            if len(counted):
                none = pa.nulls(len(counted), pa.string())
                t = pa.table([none, none, *(counted.column(c) for c in ("w", "last", "next", "count_all"))], names=names)
                yield from t.combine_chunks().to_batches()

    return listed.select("block_id", "ocr", "ws").mapInArrow(kernel, "block_id string, raw string, w string, last string, next string, s long")


def misreadings(listed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The words of scanned blocks that are misreadings: block_id, w, fix, place (of the first difference), cut and other (of joined words).

    A word is only changed where its neighbours support the change: on each side that has one, the fix stands beside
    such a neighbour somewhere else. Of several fixes the best supported is taken, then the nearest, then the most frequent.
    """
    pairs = durable(candidates(listed, limits))
    asked, sorts = pairs.select("w").distinct(), pairs.select(F.col("sort").alias("w")).distinct()
    if pairs.count() <= LOOKED_UP:
        looked = durable(_looked_up(listed, [r.w for r in asked.toLocalIterator()], [r.w for r in sorts.toLocalIterator()]))
        met, told = looked.where("block_id IS NOT NULL"), looked.where("block_id IS NULL")
    else:
        each = occurrences(listed)
        met = each.where("ocr").join(durable(asked), "w").withColumn("s", F.lit(1).cast("long"))
        told = each.withColumn("w", F.when(F.col("w").rlike(r"^\p{N}+$"), "#").otherwise(F.col("w"))).join(durable(sorts), "w").withColumn("s", F.lit(1).cast("long"))
    met = met.select("block_id", "raw", "w", _beside(F.col("last")).alias("l"), _beside(F.col("next")).alias("f"))
    met = durable(met.distinct())
    told = told.groupBy("w", "last", "next").agg(F.sum("s").alias("s"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("last").alias("by")), F.struct(F.lit("f").alias("side"), F.col("next").alias("by"))))
    told = told.select(F.col("w").alias("sort"), "s", sides.alias("x")).where("x.by IS NOT NULL").groupBy("sort", "x.side", _beside(F.col("x.by")).alias("by")).agg(F.sum("s").alias("s"))
    asks = met.join(pairs, "w").withColumn("no", F.xxhash64("block_id", "raw", "l", "f"))
    wanted = asks.select("sort", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("by")), F.struct(F.lit("f").alias("side"), F.col("f").alias("by")))).alias("x")).select("sort", "x.side", "x.by").where("by IS NOT NULL").distinct()
    support = small(durable(told.join(wanted, ["sort", "side", "by"], "left_semi")))
    for side in ("l", "f"):
        one = support.where(F.col("side") == side).select("sort", F.col("by").alias(side), F.col("s").alias(f"s_{side}"))
        asks = asks.join(one, ["sort", side], "left")
    held = lambda side: F.col(side).isNull() | F.col(f"s_{side}").isNotNull()
    # Digits among letters are no word of anyone's, so there the one side is enough.
    odd = F.col("w").rlike(r"\p{N}") & (F.col("sort") != "#")
    either = F.col("s_l").isNotNull() | F.col("s_f").isNotNull()
    kept = asks.where(either & (odd | (held("l") & held("f"))))
    total = F.coalesce("s_l", F.lit(0)) + F.coalesce("s_f", F.lit(0))
    best = kept.groupBy("block_id", "raw", "w").agg(F.max_by("fix", F.struct(total, -F.col("d"), "n", "fix")).alias("fix"))
    place = F.aggregate(F.sequence(F.lit(1), F.least(F.length("w"), F.length("fix"))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr("w", F.lit(1), i) == F.substr("fix", F.lit(1), i)), i).otherwise(acc))
    mark = F.split("raw", MARK)
    return best.select("block_id", "w", "fix", place.alias("place"), F.get(mark, F.lit(1)).try_cast("int").alias("cut"), F.nullif(F.get(mark, F.lit(2)), F.lit("")).alias("other"))


def analyse(blocks: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, line ends with a hyphen and misreadings of all blocks."""
    lines = durable(own_lines(blocks, limits))
    ends = durable(cut_words(lines))
    return lines, ends, durable(misreadings(durable(own_words(lines, ends)), limits))


def defects(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``block_id``, ``defect``: furniture, hyphen, misread; of scanned blocks, one row per defect.

    A block that is furniture as a whole has that row only. A word broken across blocks counts for the block
    it begins in; its misread characters for the block they stand in.
    """
    lines, ends, fixes = analyse(blocks, limits)
    scans = lines.where("ocr")
    furniture = scans.where("furniture").select("block_id", F.lit("furniture").alias("defect"))
    own = scans.where("NOT whole").select("block_id", "at")
    hyphen = ends.where("broken").join(own, ["block_id", "at"], "left_semi").select("block_id", F.lit("hyphen").alias("defect"))
    where = F.when(F.col("other").isNotNull() & (F.col("place") >= F.col("cut")), F.col("other")).otherwise(F.col("block_id"))
    misread = fixes.select(where.alias("block_id"), F.lit("misread").alias("defect"))
    return furniture.unionByName(hyphen).unionByName(misread).distinct()


def paragraphs(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, ``para_no``, ``first_block``, ``kind``, ``text``: the documents' own content in continuous paragraphs.

    Lines are joined, broken words too; misread words of scanned blocks are replaced. A text block goes on
    from the text block before it (whatever furniture lay between) where that one ends within a sentence and
    it begins with a small letter. Tables and headings keep their lines.
    """
    lines, ends, fixes = analyse(blocks, limits)
    own = lines.where(~F.col("furniture"))
    marks = ends.select("block_id", "at", "broken")
    own = own.join(marks, ["block_id", "at"], "left")
    joins = F.col("tail").isNotNull() & (F.coalesce("head", F.lit("")) != "")
    own = own.withColumn("joins", joins).join(_eaten(ends.where("head <> ''")), ["block_id", "at"], "left")
    bare = F.regexp_replace("line", rf"[{HYPHENS}][\s]*$", "")
    text = F.when(F.col("joins"), F.concat(bare, F.when(F.col("broken"), "").otherwise("-"), "head")).otherwise(F.col("line"))
    text = F.when(F.col("eaten").isNotNull(), F.regexp_replace(text, CUT_START, "")).otherwise(text)
    own = own.withColumn("text", text)
    # Only blocks with a misread word are taken apart.
    mended = small(durable(fixes.select("block_id").distinct()))
    whole_lines, own = own.join(mended, "block_id", "left_anti"), own.join(mended, "block_id", "left_semi")
    cut = own.select("block_id", "at", "ocr", F.posexplode(F.regexp_extract_all("text", F.lit(rf"({WORD}|[^\p{{L}}\p{{M}}\p{{N}}]+)"))).alias("i", "piece"))
    each = small(fixes.groupBy("block_id", "w").agg(F.min("fix").alias("fix")))
    fixed = cut.withColumn("w", F.when(F.col("ocr"), F.lower("piece"))).join(each, ["block_id", "w"], "left")
    capital = F.col("piece").rlike(r"^\p{Lu}")
    shaped = F.when(F.col("piece").rlike(r"^\p{Lu}{2,}"), F.upper("fix")).when(capital, F.concat(F.upper(F.substring("fix", 1, 1)), F.expr("substring(fix, 2)"))).otherwise(F.col("fix"))
    fixed = fixed.select("block_id", "at", F.struct("i", F.when(F.col("fix").isNotNull(), shaped).otherwise(F.col("piece")).alias("p")).alias("p"))
    line = fixed.groupBy("block_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["p"]), "").alias("text"))
    kept = ["doc_id", "block_id", "block_no", "kind", "at", "text"]
    own = own.drop("text").join(line, ["block_id", "at"]).select(*kept).unionByName(whole_lines.select(*kept))
    per = own.groupBy("doc_id", "block_id", "block_no", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("ls"))
    whole = F.when(F.col("kind") == "text", F.trim(F.regexp_replace(F.array_join("ls.text", " "), r"\s+", " "))).otherwise(F.array_join("ls.text", "\n"))
    per = per.select("doc_id", "block_id", "block_no", "kind", whole.alias("text")).where("text <> ''")
    read = Window.partitionBy("doc_id").orderBy("block_no", "block_id")
    goes_on = (F.col("kind") == "text") & (F.lag("kind").over(read) == "text") & F.col("text").rlike(r"^[\p{Ll}\p{Lo}(]") & ~F.lag("text").over(read).rlike(r"[.!?।:;|]['\")\]]*$")
    per = per.withColumn("para_no", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(read))
    grouped = per.groupBy("doc_id", "para_no", "kind").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_id", "text"))).alias("bs"))
    return grouped.select("doc_id", "para_no", F.col("bs.block_id")[0].alias("first_block"), "kind", F.array_join("bs.text", " ").alias("text"))
