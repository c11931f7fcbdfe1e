"""Documents: headings, cleaning, chunking. Blocks are rows (doc_id, page, block_no, kind, level, text, size, bold, ocr)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions import text as X
from lodestream.schemas import CHUNK

# Numbering and keywords of headings, and the separator of heading paths.
NUMBERED = r"^(\d+(\.\d+)*\.?|[IVX]+\.)\s+\S"
KEYWORD = r"(?i)^(CHAPTER|PART|SCHEDULE|ANNEXURE|APPENDIX|STAGE)\b"
PATH = " › "
SENTENCE = r"(?<=[.!?।;])\s+"


def body_sizes(blocks: DataFrame) -> DataFrame:
    """``doc_id``, ``body_size``: the font size of most characters outside tables; of equals the larger."""
    n = blocks.where("kind <> 'table' AND size IS NOT NULL").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return n.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", "size")).alias("body_size"))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Short (150 characters, two lines) and large, bold, a keyword, all capitals, or numbered without end punctuation."""
    short = (F.length(text) <= 150) & (F.size(F.split(text, "\n")) <= 2)
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    capitals = (letters >= 4) & (F.upper(text) == text) & (F.lower(text) != text)
    numbered = text.rlike(NUMBERED) & ~text.rlike("[.;,:]$")
    large = F.coalesce(size >= body * 1.15, F.lit(False))
    return short & (large | F.coalesce(bold, F.lit(False)) | text.rlike(KEYWORD) | capitals | numbered)


def heading_flags(blocks: DataFrame) -> DataFrame:
    """Blocks with ``heading`` as the classifier sees it (tables are none)."""
    j = blocks.join(body_sizes(blocks), "doc_id", "left")
    flag = (F.col("kind") != "table") & is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size"))
    return j.withColumn("heading", F.coalesce(flag, F.lit(False)))


def heading_levels(blocks: DataFrame, deepest: int = 3) -> DataFrame:
    """``level_by_size`` of headings: rank of their size among the document's heading sizes, ``deepest`` at most."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("size")))
    return blocks.where("kind = 'heading'").withColumn("level_by_size", F.least(rank, F.lit(deepest)))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings indented by level."""
    return blocks.where("kind = 'heading'").select("doc_id", "block_no", F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(1)) - 1), F.lit("- "), F.col("text")).alias("line"))


def needs_ocr(pages: DataFrame, text: str = "text", least: int = 50) -> DataFrame:
    """Pages with too little text of their own."""
    return pages.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < least)


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with cleaned text; those with fewer than two word characters left are dropped."""
    c = blocks.withColumn("text", X.clean_text(F.col("text"), F.col("kind")))
    return c.where(X.word_characters(F.col("text")) >= 2)


def drop_boilerplate(blocks: DataFrame, share: float = 0.5, longest: int = 200) -> DataFrame:
    """Without page numbers and short texts of one form on at least ``share`` (two at least) of the document's pages."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    keyed = blocks.withColumn("__ls_key", X.boilerplate_key(F.col("text")))
    on = keyed.where("kind <> 'table'").groupBy("doc_id", "__ls_key").agg(F.countDistinct("page").alias("n_on"))
    repeated = on.join(pages, "doc_id").where(F.col("n_on") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("n_pages")))).select("doc_id", "__ls_key", F.lit(True).alias("__ls_repeated"))
    j = keyed.join(repeated, ["doc_id", "__ls_key"], "left")
    gone = (F.col("kind") != "table") & (F.col("text").rlike(X.PAGE_NUMBER) | (F.coalesce("__ls_repeated", F.lit(False)) & (F.length("text") <= longest)))
    return j.where(~gone).drop("__ls_key", "__ls_repeated")


def clean_documents(blocks: DataFrame) -> DataFrame:
    """The whole cleaning: texts, specks, then boilerplate."""
    return drop_boilerplate(clean_blocks(blocks))


def sections(blocks: DataFrame) -> DataFrame:
    """Body blocks with ``section_no`` (from 0, sections with a body only) and ``heading_path``.

    The stack of open headings in closed form: the heading open at level k is the last one of level k or less,
    if its level is exactly k. Headings are squeezed and cut to 80 characters.
    """
    order = Window.partitionBy("doc_id").orderBy("block_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("kind") == "heading"
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(3))
    title = F.trim(F.substring(F.regexp_replace("text", r"(?U)\s+", " "), 1, 80))
    b = blocks.withColumn("raw_section", F.sum(head.cast("int")).over(upto))
    names = []
    for k in (1, 2, 3):
        at = F.last(F.when(head & (level <= k), F.struct(level.alias("l"), title.alias("t"))), ignorenulls=True).over(upto)
        b = b.withColumn(f"h{k}", at)
        names.append(F.when(F.col(f"h{k}.l") == k, F.col(f"h{k}.t")))
    b = b.withColumn("heading_path", F.concat_ws(PATH, *names)).where(~head)
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("raw_section")) - 1
    return b.withColumn("section_no", number).drop("raw_section", "h1", "h2", "h3")


def parents(blocks: DataFrame) -> DataFrame:
    """One row per section: id, path, path and texts, words."""
    s = sections(blocks)
    g = s.groupBy("doc_id", "section_no", "heading_path").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("bs"))
    body = F.array_join("bs.text", "\n")
    whole = F.when(F.col("heading_path") != "", F.concat(F.col("heading_path"), F.lit("\n"), body)).otherwise(body)
    return g.select(F.concat("doc_id", F.lit("::s"), F.lpad(F.col("section_no").cast("string"), 3, "0")).alias("parent_id"), "doc_id", "heading_path", whole.alias("text"), word_count(whole).cast("int").alias("token_count"))


# White space in Unicode's sense, the same in every count of words.
SPACE = r"\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"[{SPACE}]+"), lambda x: x != ""))


def fixed_windows(blocks: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of ``size`` words at steps of size - overlap over a document's blocks, which blank lines join; the last ends with the
    document. The CHUNK columns, without heading path and parent; the text keeps its own white space, between blocks a blank line.

    Blocks are cut where they stand, by the number of words before them; no document is ever in one place. Null
    texts and texts without words have no part in it.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    b = blocks.select("doc_id", "block_no", "page", "text", word_count(F.col("text")).alias("n")).where("n > 0")
    order = Window.partitionBy("doc_id").orderBy("block_no")
    counts = b.select("doc_id", "block_no", "n")
    before = counts.withColumn("first", F.sum("n").over(order) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id"))).drop("n")
    b = b.join(before, ["doc_id", "block_no"])
    # The windows that meet the block, and its part in each.
    last = F.greatest(F.ceil((F.col("total") - size) / F.lit(step)), F.lit(0))
    lo = F.greatest(F.floor((F.col("first") - size) / F.lit(step)) + 1, F.lit(0))
    hi = F.least(F.floor((F.col("first") + F.col("n") - 1) / F.lit(step)), last)
    b = b.withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int")).where("lo <= hi")
    schema = T.StructType([blocks.schema["doc_id"], T.StructField("c", T.IntegerType()), blocks.schema["block_no"], blocks.schema["page"], T.StructField("part", T.StringType()), T.StructField("words", T.IntegerType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(f"[^{SPACE}]+").finditer
        for r in batches:
            rows, window, parts, words = [], [], [], []
            for i, (text, first, lo, hi) in enumerate(zip(*(r.column(c).to_pylist() for c in ("text", "first", "lo", "hi")))):
                spans = [m.span() for m in find(text)]
                for c in range(lo, hi + 1):
                    a, e = max(c * step - first, 0), min(c * step + size - first, len(spans))
                    if a < e:
                        rows.append(i)
                        window.append(c)
                        parts.append(text[spans[a][0] : spans[e - 1][1]])
                        words.append(e - a)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([r.column("doc_id").take(at), pa.array(window, pa.int32()), r.column("block_no").take(at), r.column("page").take(at), pa.array(parts, pa.string()), pa.array(words, pa.int32())], names=schema.names)

    pieces = b.select("doc_id", "block_no", "page", "text", "first", "lo", "hi").mapInArrow(kernel, schema)
    g = pieces.groupBy("doc_id", "c").agg(F.array_sort(F.collect_list(F.struct("block_no", "part", "page"))).alias("ps"), F.sum("words").cast("int").alias("token_count"))
    text = F.array_join("ps.part", "\n\n")
    none = F.lit(None).cast("string")
    return g.select(
        F.concat("doc_id", F.lit("::fixed::c"), F.lpad(F.col("c").cast("string"), 3, "0")).alias("chunk_id"), "doc_id", F.lit("").alias("heading_path"), text.alias("text"), text.alias("embed_text"),
        F.col("ps.page")[0].alias("page_start"), F.element_at("ps.page", -1).alias("page_end"), none.alias("parent_id"), "token_count",
    )


Count = Callable[[str], int]


def count_words(text: str) -> int:
    """The default token count: words between white space."""
    return len(text.split())


class Packer:
    """Packs the blocks of one section greedily into pieces of at most ``most`` tokens."""

    def __init__(self, count: Count = count_words, most: int = 400, overlap: int = 60):
        import re

        self.count, self.most, self.overlap = count, most, overlap
        self.sentences = re.compile(SENTENCE).split

    def by_words(self, text: str) -> list[str]:
        out: list[list[str]] = [[]]
        for w in text.split():
            if out[-1] and self.count(" ".join([*out[-1], w])) > self.most:
                out.append([])
            out[-1].append(w)
        return [" ".join(x) for x in out if x]

    def by_rows(self, text: str) -> list[str]:
        """A table between its rows, each piece with the header; a row too long by itself is cut by words."""
        lines = text.splitlines()
        ruled = len(lines) > 1 and not set(lines[1].replace("|", "").strip()) - set("-: ")
        top = lines[: 1 + ruled]
        if len(lines) == len(top):  # no rows to cut between
            return self.by_words(text)
        fits = lambda rows: self.count("\n".join([*top, *rows])) <= self.most
        out, held = [], []
        for row in lines[len(top) :]:
            if held and not fits([*held, row]):
                out.append("\n".join([*top, *held]))
                held = []
            if held or fits([row]):
                held.append(row)
            else:
                out += self.by_words(row)
        return [*out, "\n".join([*top, *held])] if held else out

    def units(self, text: str, kind: str) -> list[tuple[str, bool]]:
        table = kind == "table"
        if self.count(text) <= self.most:
            return [(text, table)]
        if table:
            return [(x, True) for x in self.by_rows(text)]
        return [(x, False) for s in self.sentences(text) for x in ([s] if self.count(s) <= self.most else self.by_words(s))]

    def tail(self, text: str) -> str:
        words = text.split()
        k = len(words)
        while k and self.count(" ".join(words[k - 1 :])) <= self.overlap:
            k -= 1
        return " ".join(words[k:])

    def pack(self, blocks: list[tuple[str, str, int]]) -> list[tuple[str, int, int]]:
        """(text, first page, last page) of each piece. Prose pieces overlap where the overlap still fits; tables never do."""
        done, texts, pages, size, after_table = [], [], [], 0, False

        def flush() -> None:
            done.append(("\n".join(texts).strip(), min(pages), max(pages)))

        for text, kind, page in blocks:
            for unit, table in self.units(text, kind):
                n = self.count(unit)
                if texts and size + n > self.most:
                    flush()
                    kept = "" if table or after_table else self.tail("\n".join(texts))
                    k = self.count(kept) if kept else 0
                    carry = bool(kept) and k + n <= self.most
                    texts, pages, size = ([kept], [pages[-1]], k) if carry else ([], [], 0)
                texts.append(unit)
                pages.append(page)
                size, after_table = size + n, table
        if texts:
            flush()
        return done


def structure_chunks(blocks: DataFrame, count: Count = count_words, most: int = 400, overlap: int = 60) -> DataFrame:
    """Chunks along sections, blocks and sentences; see Packer. One task packs one section at a time, never a document group."""
    s = sections(blocks)
    g = s.groupBy("doc_id", "section_no", "heading_path").agg(F.array_sort(F.collect_list(F.struct("block_no", "text", "kind", "page"))).alias("bs"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Packer(count, most, overlap)
        for b in batches:
            out = []
            for doc, no, path, bs in b.itertuples(index=False):
                parent = f"{doc}::s{no:03d}"
                for k, (text, first, last) in enumerate(p.pack([(x["text"], x["kind"], x["page"]) for x in bs])):
                    out.append((f"{parent}::c{k:02d}", doc, path, text, f"{path}\n{text}" if path else text, first, last, parent, count(text)))
            yield pd.DataFrame(out, columns=CHUNK.names)

    return g.mapInPandas(kernel, CHUNK)


def with_metadata(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks with their documents' typed metadata."""
    return chunks.join(typed_manifest(manifest), "doc_id", "left")


def typed_manifest(manifest: DataFrame) -> DataFrame:
    """Blanks to null, cities to an array, flags and dates to their types."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    cities = F.filter(F.split(F.coalesce("cities", F.lit("")), ";"), lambda x: x != "")
    return manifest.select("doc_id", "title", "doc_type", "jurisdiction", cities.alias("cities"), "language", (F.coalesce("is_current", F.lit("")) == "true").alias("is_current"), filled("published_on").try_cast("date").alias("published_on"), filled("source_url").alias("source_url"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.max("token_count").alias("max_tokens"))
