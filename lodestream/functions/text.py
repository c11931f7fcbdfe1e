"""Text expressions: glyphs, prose and table cleaning, comparison forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of symbol fonts and the characters they stand for.
SYMBOLS = {0xF06D: "µ", 0xF061: "α", 0xF062: "β", 0xF0B3: "≥", 0xF0A3: "≤", 0xF0B0: "°", 0xF020: " ", 0xF0B7: "•", 0xF0A8: "•", 0xF0A7: "•", 0xF0D8: "•"}
# Typographic quotes, dashes and the no-break space with their plain forms.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " "}
# Fixed value: a text that is only a page number.
PAGE_NUMBER = r"(?iU)^\W*(page\s*)?\d+(\s*(of|/)\s*\d+)?\W*$"


def normal_form(c: Column, form: str = "NFC") -> Column:
    """Unicode normalisation; Spark has no built-in for it, so an Arrow batch does it. ASCII texts come back as they are."""

    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return F.when(c.rlike(r"[^\x00-\x7F]"), normalise(c)).otherwise(c)


def fix_glyphs(c: Column) -> Column:
    """Symbol-font code points to what they show, other private-use characters off, Greek mu before a unit to the micro sign."""
    c = F.translate(c, "".join(map(chr, SYMBOLS)), "".join(SYMBOLS.values()))
    c = F.regexp_replace(c, "[\\uE000-\\uF8FF]", "")
    return F.regexp_replace(c, "μ(?=g\\s*/\\s*m|m\\b)", "µ")


def clean_prose(c: Column) -> Column:
    """Small letters broken by a hyphen at a line end joined, white space to single spaces."""
    c = F.regexp_replace(c, r"([a-z])-\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_table(c: Column) -> Column:
    """A markdown table: line breaks and bold marks off, generated column names blank, the copies of a merged text cell
    blank, empty rows and rows like the one before off; the first row is the header and stays."""
    lines = F.split(c, r"\r?\n")
    squeeze = lambda x: F.trim(F.regexp_replace(F.replace(F.replace(x, F.lit("<br>"), F.lit(" ")), F.lit("**"), F.lit("")), r"(?U)\s+", " "))
    cells_of = lambda line: F.transform(F.slice(F.split(line, r"\|", -1), 2, F.greatest(F.size(F.split(line, r"\|", -1)) - 2, F.lit(0))), squeeze)

    def row(line: Column) -> Column:
        cells = cells_of(line)
        rule = (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike(r"^:?-{3,}:?$"))
        named = F.transform(cells, lambda x: F.when(x.rlike(r"^Col\d+$"), "").otherwise(x))
        merged = F.transform(named, lambda x, i: F.when((i > 0) & (x == F.get(named, i - 1)) & x.rlike(r"\p{L}"), "").otherwise(x))
        full = F.exists(merged, lambda x: x != "")
        text = F.concat(F.lit("|"), F.array_join(merged, "|"), F.lit("|"))
        return F.struct(F.when(rule, F.trim(line)).otherwise(text).alias("text"), rule.alias("rule"), full.alias("full"))

    rows = F.transform(lines, row)

    def keep(acc: Column, r: Column) -> Column:
        add = r["rule"] | (F.size(acc) == 0) | (r["full"] & (r["text"] != F.element_at(acc, -1)))
        return F.when(add, F.concat(acc, F.array(r["text"]))).otherwise(acc)

    return F.array_join(F.aggregate(rows, F.array().cast("array<string>"), keep), "\n")


def clean_text(text: Column, kind: Column) -> Column:
    """NFC, glyphs, then the cleaner of the kind of block."""
    fixed = fix_glyphs(normal_form(text))
    return F.when(kind == "table", clean_table(fixed)).otherwise(clean_prose(fixed))


def boilerplate_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "#"), r"(?U)\s+", " "))


def word_characters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\W", ""))


def comparison_form(c: Column) -> Column:
    """Compatibility form, plain quotes and dashes, no table marks, lower case, single spaces."""
    c = F.lower(F.translate(normal_form(c, "NFKC"), "".join(PLAIN), "".join(PLAIN.values())))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[|*_`#]", " "), r"(?U)\s+", " "))


def covers(text: Column, quote: Column, least: int = 12) -> Column:
    """Whether a text in comparison form holds a quote, or either half of a quote of ``least`` words."""
    words = F.split(quote, " ")
    mid = F.floor(F.size(words) / 2).cast("int")
    halves = text.contains(F.array_join(F.slice(words, 1, mid), " ")) | text.contains(F.array_join(F.slice(words, mid + 1, F.size(words)), " "))
    return text.contains(quote) | ((F.size(words) >= least) & halves)
