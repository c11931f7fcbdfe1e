"""Passages of held-out items inside a corpus, found by winnowed fingerprints and extended hits.

Texts become sequences of words (compatibility forms, case folded, invisible characters and punctuation
off), so that case, punctuation, spacing and layout don't matter; in scripts written without spaces every
character is a word. The fingerprints of a text are the minima of the hashes of its k-grams over each window
of w grams; two texts that share k+w-1 words on end share a fingerprint, whatever surrounds them.
Fingerprints of corpus and items are joined, every hit is extended to the whole run of equal words and on over
at most ``gap`` other words on either side, where shorter runs need no fingerprint of their own; runs that
follow one another in both texts with at most ``gap`` other words between them form one shared stretch.

The corpus is read once, however many items there are. Before the join, fingerprints of the corpus that no
item can have are dropped by a bitmap of the items' fingerprints, whose size is bounded (a fuller bitmap only
lets more through to the join, which is exact). A fingerprint that many passages share is salted on the
items' side. Documents travel to the join as stretches round their hits, never whole for each item.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.runtime import durable

#: Words of a gram, and grams of a window: every run of K + W - 1 = 6 words shares a fingerprint. Shorter grams match by chance more often.
K, W = 5, 2
#: Bits of the bitmap of fingerprints: at least, at most (16 MB), and for each fingerprint.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 4096
#: Passages that meet a fingerprint's hits in one task, beyond which it is salted.
SHARED_PART = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Scripts that are written without spaces.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def _cutter():
    import regex

    spaced = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
    unspaced = regex.compile(rf"[{_UNSPACED}]")
    both = regex.compile(rf"[{_UNSPACED}]\p{{M}}*|[[\p{{L}}\p{{M}}\p{{N}}]--[{_UNSPACED}]]+", regex.V1).findall
    return lambda text: both(text) if unspaced.search(text) else spaced(text)


@lru_cache(maxsize=1)
def _invisible():
    import regex

    return regex.compile(r"\p{Cf}+").sub


def words(text: str, cut) -> list[str]:
    """The words of a text in comparison form."""
    if not text.isascii():
        text = _invisible()("", unicodedata.normalize("NFKC", text))
    return cut(text.casefold())


def word_codes(parts: Sequence[str]) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal codes in every task."""
    codes, names = pd.factorize(np.asarray(parts, dtype=object))
    if not len(names):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes]


def fingerprints(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions of the winnowed k-grams of several texts laid end to end; ``of`` is each word's text."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = gram_codes(codes)
    whole = of[:n] == of[K - 1 :]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(whole, h, top)
    chosen = np.zeros(n, bool)
    # The minimum of each window of W grams of one text; the last of equal ones. Short texts are one window.
    best = np.arange(n)
    for k in range(1, W):
        at = np.minimum(np.arange(n) + k, n - 1)
        take = (of[at] == of[:n]) & whole[at] & (h[at] <= h[best])
        best = np.where(take, at, best)
    full = whole.copy()
    end = np.minimum(np.arange(n) + W - 1, n - 1)
    inside = full & (of[end] == of[:n]) & whole[end] & (np.arange(n) + W - 1 < n)
    chosen[best[inside]] = True
    first = np.flatnonzero(full & np.concatenate(([True], of[1:n] != of[: n - 1])))
    chosen[best[first]] = True
    return np.flatnonzero(chosen)


def gram_codes(codes: np.ndarray) -> np.ndarray:
    """The hash of the K words from each position on."""
    n = len(codes) - K + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            h = (h ^ codes[k : k + n]) * _BASE
            h ^= h >> np.uint64(29)
    return h


def _grow(doc: list[int], own: list[int], found: set[tuple[int, int, int]], gap: int) -> None:
    """Adds the runs that lie at most ``gap`` other words from a found one, and from those on."""
    todo = list(found)
    while todo:
        d, p, n = todo.pop()
        for gd in range(gap + 1):
            for gp in range(gap + 1):
                for e, f in ((d + n + gd, p + n + gp), (d - 1 - gd, p - 1 - gp)):
                    if not (0 <= e < len(doc) and 0 <= f < len(own) and doc[e] == own[f]):
                        continue
                    run = _run(doc, own, e, f)
                    if (gd == gp or run[2] > 1) and run not in found:  # one word off the diagonal is chance
                        found.add(run)
                        todo.append(run)


def _run(doc: list[int], own: list[int], d: int, p: int) -> tuple[int, int, int]:
    """The whole run of equal words about a place: where it begins in both, and its length."""
    a, b = d, p
    while a > 0 and b > 0 and doc[a - 1] == own[b - 1]:
        a, b = a - 1, b - 1
    e, f = d, p
    while e < len(doc) and f < len(own) and doc[e] == own[f]:
        e, f = e + 1, f + 1
    return a, b, e - a


def stretch(doc: list[int], numeric: list[bool], own: list[int], own_numeric: list[bool], seeds: Sequence[tuple[int, int]], gap: int) -> tuple[int, int, int, int, int]:
    """The best shared stretch: (words alike, changes, longest run on end, first and last word of the document)."""
    found: set[tuple[int, int, int]] = set()
    ends: dict[int, int] = {}
    for d, p in sorted(seeds):
        if ends.get(p - d, -1) <= d:
            run = _run(doc, own, d, p)
            ends[p - d] = run[0] + run[2]
            found.add(run)
    _grow(doc, own, found, gap)
    chain: list[tuple[int, int, int, int, int, int, int]] = []
    best = (0, 0, 0, 0, 0)
    for d, p, n in sorted(found):
        alike, wrong, longest, first = n, 0, n, d
        chain = [c for c in chain if c[0] + c[2] + gap >= d]  # the others ended too long ago
        for d0, p0, n0, a0, w0, l0, f0 in chain:
            gd, gp = d - d0 - n0, p - p0 - n0
            cut = max(0, -gd, -gp)  # runs that overlap by repeated words
            if gd + cut <= gap and gp + cut <= gap and n > cut:
                cost = max(gd, gp) + cut
                # A number for another number is another statement, not a small change.
                if gd == gp and gd > 0 and any(numeric[d0 + n0 + k] and own_numeric[p0 + n0 + k] for k in range(gd)):
                    cost += gap
                if a0 + n - cut - 2 * (w0 + cost) > alike - 2 * wrong:
                    alike, wrong, longest, first = a0 + n - cut, w0 + cost, max(l0, n), f0
        chain.append((d, p, n, alike, wrong, longest, first))
        if alike - 2 * wrong > best[0] - 2 * best[1]:
            best = (alike, wrong, longest, first, d + n)
    return best


def accept(found: dict, least: int, rate: float) -> list:
    """The items that leaked: ``least`` words on end, or as many alike with few changes that no better item explains.

    Items made after one pattern resemble one another; a stretch with changes counts only if at least
    ``least`` of its words lie outside the stretches of the items that fit the document better there.
    """
    out, taken = [], []
    for item, (alike, wrong, longest, a, b) in sorted(found.items(), key=lambda x: (2 * x[1][1] - x[1][0], x[0])):
        if longest < least:
            if alike < least or wrong > alike * rate:
                continue
            free = np.ones(b - a, bool)
            for x, y in taken:
                free[max(0, x - a) : max(0, y - a)] = False
            if free.sum() < least:
                continue
        out.append(item)
        taken.append((a, b))
    return out


def prints(df: DataFrame, text_col: str, keep: Sequence[str], bitmap: np.ndarray | None = None, bits: int = 0) -> DataFrame:
    """``keep``, ``codes`` (of the words), ``numeric`` (which are numbers), ``h`` and ``at`` (fingerprints and where they begin).

    With a bitmap only fingerprints in it, and only texts with one.
    """
    long, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("codes", long), T.StructField("numeric", T.ArrayType(T.BooleanType())), T.StructField("h", long), T.StructField("at", ints)])
    names = schema.names
    sent = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter()
        for b in batches:
            parts = [words(t, cut) for t in b.column(b.num_columns - 1).to_pylist()]
            flat = [x for w in parts for x in w]
            size = np.array([len(w) for w in parts], dtype=np.int64)
            codes = word_codes(flat)
            of = np.repeat(np.arange(len(parts)), size)
            start = np.cumsum(size) - size
            at = fingerprints(codes, of)
            h = gram_codes(codes)[at] if len(at) else np.zeros(0, np.uint64)
            if sent is not None and len(at):
                place = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
                hit = (sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                at, h = at[hit == 1], h[hit == 1]
            row = of[at] if len(at) else np.zeros(0, np.int64)
            rows = np.unique(row) if sent is not None else np.arange(len(parts))
            kept = np.isin(of, rows)
            ends = pa.array(np.concatenate(([0], np.cumsum(size[rows]))).astype(np.int32))
            hits = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(parts))[rows]))).astype(np.int32))
            digits = np.array([x.isdigit() for x, k in zip(flat, kept) if k], dtype=bool)
            lists = [pa.ListArray.from_arrays(ends, pa.array(codes[kept].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(digits)), pa.ListArray.from_arrays(hits, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(hits, pa.array((at - start[row]).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows)) for k in range(len(keep))), *lists], names=names)

    return df.select(*keep, F.col(text_col).alias("__ls_text")).mapInArrow(kernel, schema)


def _bitmap(fingerprint: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of the fingerprints' low bits, put together by Spark."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(count, 1) * BITS_EACH)))))
    place = F.pmod("h", F.lit(1 << bits)) + 1
    parts = fingerprint.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(((1 << bits) >> 3) + 4096, np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


def stretches(corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, gap: int = 3) -> DataFrame:
    """``__ls_row`` (a row of the corpus), ``id_col``, ``item_col``, alike, wrong, longest, first, last: the best stretch that each
    document shares with each item, of all that share a fingerprint."""
    rows = items.select(F.col(item_col).alias("__ls_item"), F.col(passage_col).alias("__ls_passage")).dropna().distinct()
    own = durable(prints(rows, "__ls_passage", ["__ls_item"]).where("size(codes) > 0").withColumn("__ls_no", F.monotonically_increasing_id()))
    fingerprint = durable(own.select("__ls_no", F.explode(F.arrays_zip("h", "at")).alias("x")).select("__ls_no", F.col("x.h").alias("h"), F.col("x.at").alias("p")))
    bitmap, bits = _bitmap(fingerprint, fingerprint.count())
    texts = corpus.select(F.col(id_col).alias("__ls_id"), F.col(text_col).alias("__ls_text")).where("__ls_text IS NOT NULL")
    docs = durable(prints(texts, "__ls_text", ["__ls_id"], bitmap, bits).withColumn("__ls_row", F.monotonically_increasing_id()))

    # Hits. A fingerprint of many passages is split by passage, and the documents' hits go to every part.
    parts = fingerprint.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / SHARED_PART).cast("int").alias("parts"))
    seen = docs.select("__ls_row", F.explode(F.arrays_zip("h", "at")).alias("x")).select("__ls_row", F.col("x.h").alias("h"), F.col("x.at").alias("d"))
    seen = seen.join(parts, "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    salted = fingerprint.join(parts, "h").withColumn("salt", F.pmod(F.xxhash64("__ls_no"), F.col("parts")).cast("int")).drop("parts")
    hits = seen.join(salted, ["h", "salt"]).groupBy("__ls_row", "__ls_no").agg(F.collect_list(F.struct("d", "p")).alias("seeds"), F.min("d").alias("lo"), F.max("d").alias("hi"))

    # Of a document only what lies round its hits goes on. A stretch counts by its words alike less twice its changes, so it
    # has fewer changes than half the passage has words, and spans less than one and a half passages.
    sized = own.select("__ls_no", "__ls_item", F.col("codes").alias("own"), F.col("numeric").alias("own_numeric"))
    near = hits.join(own.select("__ls_no", F.size("codes").alias("reach")), "__ls_no")
    near = near.join(docs.select("__ls_row", "__ls_id", "codes", "numeric"), "__ls_row")
    margin = (F.col("reach") * 3 / 2).cast("int") + K + gap
    near = near.withColumn("base", F.greatest(F.lit(0), F.col("lo") - margin)).withColumn("width", F.col("hi") + margin - F.col("base"))
    near = near.select("__ls_row", "__ls_id", "__ls_no", "base", F.slice("codes", F.col("base") + 1, F.col("width")).alias("codes"), F.slice("numeric", F.col("base") + 1, F.col("width")).alias("numeric"), "seeds")
    near = near.join(sized, "__ls_no")
    kinds = T.StructType([T.StructField("__ls_row", T.LongType()), T.StructField(id_col, corpus.schema[id_col].dataType), T.StructField(item_col, items.schema[item_col].dataType), *(T.StructField(c, T.IntegerType()) for c in ("alike", "wrong", "longest", "first", "last"))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = {n: b.column(n).offsets.to_numpy() for n in ("codes", "own", "seeds")}
            flat = {n: b.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("codes", "numeric", "own", "own_numeric")}
            base, seeds = b.column("base").to_numpy(), b.column("seeds").flatten()
            d, p = seeds.field("d").to_numpy(), seeds.field("p").to_numpy()
            (c0, o0, s0), out = (x[0] for x in cuts.values()), []
            for i in range(b.num_rows):
                c, e = cuts["codes"][i] - c0, cuts["codes"][i + 1] - c0
                f, g = cuts["own"][i] - o0, cuts["own"][i + 1] - o0
                x, y = cuts["seeds"][i] - s0, cuts["seeds"][i + 1] - s0
                at = list(zip((d[x:y] - base[i]).tolist(), p[x:y].tolist()))
                n, wrong, longest, first, last = stretch(flat["codes"][c:e].tolist(), flat["numeric"][c:e], flat["own"][f:g].tolist(), flat["own_numeric"][f:g], at, gap)
                out.append((n, wrong, longest, first + int(base[i]), last + int(base[i])))
            found = [pa.array([x[k] for x in out], pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("__ls_row"), b.column("__ls_id"), b.column("__ls_item"), *found], names=kinds.names)

    return near.mapInArrow(kernel, kinds)


def find_leaks(
    corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str,
    least: int = 12, gap: int = 3, rate: float = 1 / 6,
) -> DataFrame:
    """``id_col`` and ``item_col``: every document that holds at least ``least`` words of a passage on end.

    Small changes (case, punctuation, spacing, layout, a changed or added word here and there: one in
    1/rate words at most) don't interrupt a stretch, but the one or two words beyond a last change don't
    count, as they can be alike by chance. Null and empty texts and passages share nothing; items and
    documents that are given twice are one.
    """
    found = stretches(corpus, id_col, text_col, items, item_col, passage_col, gap).where(F.col("alike") >= least)
    per = found.groupBy("__ls_row", id_col).agg(F.collect_list(F.struct(F.col(item_col).alias("i"), "alike", "wrong", "longest", "first", "last")).alias("x"))
    kind = items.schema[item_col].dataType

    @F.pandas_udf(T.ArrayType(kind))
    def accepted(each: pd.Series) -> pd.Series:
        out = []
        for xs in each:
            best: dict = {}
            for x in sorted(xs, key=lambda x: 2 * x["wrong"] - x["alike"], reverse=True):  # the best passage of an item
                best[x["i"]] = (x["alike"], x["wrong"], x["longest"], x["first"], x["last"])
            out.append(accept(best, least, rate))
        return pd.Series(out)

    return per.select(id_col, F.explode(accepted("x")).alias(item_col)).distinct()
