"""Sparse search: postings as one list per text, and exact products of many queries with many texts.

A product is bounded before it is made. The terms are put into groups, the heaviest alone in theirs; in a group a query and a
text have at most the product of their lengths there (Cauchy-Schwarz), so the bound is a product of small dense matrices. Only pairs
whose bound reaches the query's k-th best score among the longest texts are scored in full, so nothing is lost. Equal texts, and
equal queries, are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.runtime import durable, scratch_path, small

#: Terms of queries that one pass over the postings takes, pairs that one pass counts, distinct terms sent to the tasks.
PASS, PAIRS, VOCABULARY = 4_000_000, 4_000_000, 500_000
#: Queries without a bound that are multiplied at once; texts and queries of one dense product; elements of what is held densely.
LOOSE_BLOCK, TEXTS, QUERIES, CELLS = 250, 1024, 4096, 4_000_000
#: Groups of terms, of which half are single terms, and the longest texts that give the first bound.
GROUPS, LONGEST = 512, 8192
#: Texts whose words are counted at once; distinct texts that are sent to the tasks to leave out the others.
COUNTED, DISTINCT = 250, 4_000_000
#: What single precision may be off by, as a share of the product of the lengths.
SLACK = 5e-5
DIGITS = 6


def words(text) -> F.Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def posting_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``t``, ``tf``, ``w``, ``n``, ``m``: what ``retrieve.postings`` gives, as arrays, one row per id with words, with the sum of
    squares and the least of the weights; a written table.

    Words are counted text by text, so that only texts whose id occurs again are shuffled. ``t`` holds codes of terms, and the table
    of the terms is named in its metadata; ``h`` is a hash of the text. Where an id occurs again, or there are more than
    ``VOCABULARY`` terms, ``t`` holds the terms and there is no ``h``.
    """
    if not docs.groupBy(id_col).count().where("count > 1").limit(1).count() and (lists := _coded_lists(docs, id_col, text_col)) is not None:
        return lists
    return _term_lists(docs, id_col, text_col)


def _coded_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """None if there are too many terms, or two of one hash."""
    s, ids = docs.sparkSession, T.StructField("id", docs.schema[id_col].dataType)
    kind = T.StructType([ids, T.StructField("h", T.BinaryType()), T.StructField("t", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    kind.add("v", T.ArrayType(T.StructType().add("term", "string").add("hash", "long").add("df", "long")))
    lower = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("x"))
    counted = durable(lower.select("id", F.unhex(F.sha2("x", 256)).alias("h"), "x").mapInArrow(_spelt(s.sparkContext.broadcast(word_characters(s))), kind))
    n = counted.where("id IS NOT NULL").count()  # as the SQL counts them
    v = durable(counted.select(F.inline("v")).groupBy("term", "hash").agg(F.sum("df").alias("df")))
    if v.count() > VOCABULARY:
        return None
    v = v.toArrow().to_pandas().sort_values("term", ignore_index=True)
    if v["hash"].duplicated().any():
        return None
    path = scratch_path(s, "terms")
    terms = durable(s.createDataFrame(pa.table({"term": pa.array(v["term"], pa.string()), "code": pa.array(range(len(v)), pa.int32())})), path)
    sent = s.sparkContext.broadcast((pa.array(v["hash"].to_numpy()), np.log((n + 1.0) / (v["df"].to_numpy() + 0.5))))
    kind = T.StructType([ids, kind["h"], T.StructField("t", T.ArrayType(T.IntegerType()), metadata={"terms": path}), kind["tf"], T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("n", T.DoubleType()), T.StructField("m", T.DoubleType())])
    return durable(counted.select("id", "h", "t", "tf").mapInArrow(_weighted(sent), kind))


def word_characters(s: SparkSession) -> np.ndarray:
    """Of every code point whether ``words`` has it in a word."""
    x = s.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"))
    out = np.zeros(0x110000, dtype=bool)
    out[x.where(F.col("c").rlike(r"[\p{L}\p{M}\p{N}]")).select("id").toArrow()["id"].to_numpy()] = True
    return out


def split(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """How many words each text has, and all words."""
    cut = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]]
    cut = cut - cut[0]
    chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    within = inside[chars]
    if len(chars) < len(raw):
        within = np.repeat(within, np.diff(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))))
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[cut] = True
    first = within.copy()
    first[1:] &= ~within[:-1] | edge[1:-1]
    first = np.flatnonzero(first)
    data, ends = raw[within], np.cumsum(within, dtype=np.int32)
    starts = np.append(ends[first] - 1, len(data)).astype(np.int32)
    return np.diff(np.searchsorted(first, cut)), pa.StringArray.from_buffers(len(first), pa.py_buffer(starts), pa.py_buffer(data))


def _valid(texts: pa.Array) -> pa.Array:
    """Bytes that are no UTF-8 as Spark reads them."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())


def _spelt(sent):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = sent.value
        for b in batches:
            rows, sizes, codes, counts, terms, hashes, dfs = [], [], [], [], [], [], []
            x = _valid(b.column("x"))
            for at in range(0, b.num_rows, COUNTED):
                size, w = split(x.slice(at, COUNTED), inside)
                if not len(w):
                    continue
                d = w.dictionary_encode()
                m = len(d.dictionary)
                key = np.repeat(np.arange(len(size)), size) * m + d.indices.to_numpy()
                if len(size) * m <= CELLS:
                    n = np.bincount(key, minlength=len(size) * m)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                row, local = np.divmod(key, m)
                size = np.bincount(row, minlength=len(size))
                h = pd.util.hash_array(d.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
                some = np.flatnonzero(size)
                for to, one in ((rows, some + at), (sizes, size[some]), (codes, h[local]), (counts, n), (terms, d.dictionary), (hashes, h), (dfs, np.bincount(local, minlength=m))):
                    to.append(one)
            if not rows:
                continue
            rows, size, hashes = np.concatenate(rows), np.concatenate(sizes), np.concatenate(hashes)
            d = pa.concat_arrays(terms).dictionary_encode()
            i = d.indices.to_numpy()
            h, df = np.empty(len(d.dictionary), dtype=np.int64), np.bincount(i, np.concatenate(dfs), len(d.dictionary)).astype(np.int64)
            h[i] = hashes
            v = pa.StructArray.from_arrays([d.dictionary, pa.array(h), pa.array(df)], names=["term", "hash", "df"])
            first = np.zeros(len(rows), dtype=np.int64)
            first[0] = len(v)
            held = [b.column(c).take(pa.array(rows)) for c in ("id", "h")]
            yield pa.RecordBatch.from_arrays([*held, _lists(size, pa.array(np.concatenate(codes))), _lists(size, pa.array(np.concatenate(counts), pa.int32())), _lists(first, v)], names=["id", "h", "t", "tf", "v"])

    return kernel


def _term_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("t", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    counted = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("t")).mapInArrow(_counted, kind)
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        merged = counted.groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t"), F.flatten(F.collect_list("tf")).alias("tf"))
        counted = merged.mapInArrow(_counted, kind)
    counted = durable(counted)
    n = counted.where("id IS NOT NULL").count()  # as the SQL counts them
    df = durable(counted.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = df.select("term", F.log((F.lit(n) + 1.0) / (F.col("df") + 0.5)).alias("idf"))
    if df.count() > VOCABULARY:
        long = counted.select("id", F.explode(F.arrays_zip("t", "tf")).alias("p")).select("id", F.col("p.t").alias("term"), F.col("p.tf").alias("tf")).join(idf, "term")
        g = long.groupBy("id").agg(F.collect_list(F.struct("term", "tf", (F.col("tf") * F.col("idf")).alias("w"))).alias("p"))
        return durable(_sized(g.select("id", F.col("p.term").alias("t"), F.col("p.tf").alias("tf"), F.col("p.w").alias("w"))))
    known = idf.toArrow().to_pandas()
    sent = docs.sparkSession.sparkContext.broadcast((pa.array(known["term"], pa.string()), known["idf"].to_numpy(dtype=float)))
    return durable(counted.mapInArrow(_weighted(sent), T.StructType([*kind, T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("n", T.DoubleType()), T.StructField("m", T.DoubleType())])))


def long(lists: DataFrame) -> DataFrame:
    """``id``, ``term``, ``tf``, ``weight`` of posting lists."""
    out = lists.select("id", F.explode(F.arrays_zip("t", "tf", "w")).alias("p")).select("id", F.col("p.t").alias("term"), F.col("p.tf").cast("long").alias("tf"), F.col("p.w").alias("weight"))
    if (terms := terms_of(lists)) is None:
        return out
    return out.withColumnRenamed("term", "code").join(small(terms, VOCABULARY), "code").select("id", "term", "tf", "weight")


def terms_of(lists: DataFrame) -> DataFrame | None:
    """``term``, ``code`` of lists that hold codes."""
    path = lists.schema["t"].metadata.get("terms")
    return path and lists.sparkSession.read.schema("term string, code int").parquet(path)


def is_lists(posts: DataFrame) -> bool:
    return "t" in posts.columns


def gathered(posts: DataFrame) -> DataFrame:
    """``id``, ``t``, ``w``, ``n``, ``m`` of postings in either form."""
    if is_lists(posts):
        return posts.select("id", "t", "w", "n", "m", *[c for c in ("h",) if c in posts.columns])
    g = posts.groupBy("id").agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))).alias("p"))
    return durable(_sized(g.select("id", F.col("p.term").alias("t"), F.col("p.weight").alias("w"))))


def once(lists: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Lists of distinct texts, where at least a fifth repeat others; and ``id``, ``copy``: of each the k first ids that have the text."""
    if "h" not in lists.columns:
        return lists, None
    w = Window.partitionBy("h").orderBy("id")
    copies = lists.where("id IS NOT NULL").select("h", "id").select(F.first("id").over(w).alias("id"), F.col("id").alias("copy"), F.row_number().over(w).alias("n"))
    copies = durable(copies.where(F.col("n") <= k))
    kept = durable(copies.where("n = 1").select(F.col("id"), F.lit(True).alias("kept")))
    n = kept.count()
    if n > DISTINCT or n > 0.8 * lists.count():
        return lists, None
    lists = lists.join(small(kept, DISTINCT), "id", "left").where("kept OR id IS NULL").drop("kept")
    parts = 4 * lists.sparkSession.sparkContext.defaultParallelism  # the first ids may all lie in one file
    return durable(lists.repartition(parts)), copies.select("id", "copy")


def _sized(lists: DataFrame) -> DataFrame:
    return lists.withColumns({"n": F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x), "m": F.array_min("w")})


def _lists(size: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pc.fill_null(pc.list_value_length(b.column("t")), 0).to_numpy(zero_copy_only=False)
        coded = b.column("t").flatten().dictionary_encode()
        m = max(1, len(coded.dictionary))
        key = np.repeat(np.arange(b.num_rows), size) * m + coded.indices.to_numpy(zero_copy_only=False)
        if "tf" in b.schema.names:  # of texts with one id
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, b.column("tf").flatten().to_numpy(), len(key)).astype(np.int64)
        else:
            key, n = np.unique(key, return_counts=True)
        size = np.bincount(key // m, minlength=b.num_rows)
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(some)), _lists(size[some], coded.dictionary.take(pa.array(key % m))), _lists(size[some], pa.array(n, pa.int64()))], names=["id", "t", "tf"])


def _weighted(sent):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = sent.value
        for b in batches:
            at = pc.index_in(b.column("t").flatten(), value_set=terms)
            w = b.column("tf").flatten().to_numpy() * idf[at.to_numpy(zero_copy_only=False)]
            if b.num_rows:
                start = b.column("t").offsets.to_numpy()
                each = [pa.array(f.reduceat(x, start[:-1])) for f, x in ((np.add, w**2), (np.minimum, w))]
                t = _lists(np.diff(start), at) if pa.types.is_integer(terms.type) else b.column("t")
                held = [b.column(c) for c in b.schema.names if c in ("id", "h")]
                yield pa.RecordBatch.from_arrays([*held, t, b.column("tf"), _lists(np.diff(start), pa.array(w)), *each], names=[*("id", "h")[: len(held)], "t", "tf", "w", "n", "m"])

    return kernel


class Asked:
    """Queries as rows of term codes and weights, with what bounds their products."""

    def __init__(self, q: pd.DataFrame, terms: pa.Array):
        rows, ids = pd.factorize(q["query_id"], use_na_sentinel=False)
        key, back = np.unique(rows * max(1, len(terms)) + q["code"].to_numpy(dtype=np.int64), return_inverse=True)
        self.ids, self.terms = pa.array(ids), terms
        self.weight = np.bincount(back, q["weight"].to_numpy(dtype=float), len(key))
        self.code = (key % max(1, len(terms))).astype(np.int32)
        self.start = np.searchsorted(key, np.arange(len(ids) + 1) * max(1, len(terms)))
        self.norm = np.sqrt(np.bincount(key // max(1, len(terms)), self.weight**2, len(ids)))
        self.floor = np.zeros(len(ids))

    @classmethod
    def of_lists(cls, q: pa.Table) -> Asked:
        """Of query_id, t, w, where no query has a term twice."""
        out, q = cls.__new__(cls), q.combine_chunks()
        t, w = (q[c].combine_chunks() if q.num_rows else pa.array([], q.schema.field(c).type) for c in ("t", "w"))
        flat = t.flatten()
        out.terms = pc.unique(flat).sort()
        code, size = pc.index_in(flat, value_set=out.terms).to_numpy(zero_copy_only=False), pc.list_value_length(t).to_numpy(zero_copy_only=False)
        out.ids, out.start = q["query_id"].combine_chunks() if q.num_rows else pa.array([], q.schema.field("query_id").type), np.append(0, np.cumsum(size)).astype(np.int64)
        of = np.repeat(np.arange(len(size)), size)
        order = np.argsort(of * max(1, len(out.terms)) + code, kind="stable")
        out.code, out.weight = code[order].astype(np.int32), w.flatten().to_numpy()[order]
        out.norm, out.floor = np.sqrt(np.bincount(of, out.weight**2, len(size))), np.zeros(len(size))
        return out

    def merged(self) -> pa.Table | None:
        """Leaves one of each kind of equal queries, by number; gives ``at`` (the number) and ``query_id`` if any were equal."""
        kinds: dict[bytes, int] = {}
        at, first = np.empty(len(self.ids), dtype=np.int64), []
        for i in range(len(self.ids)):
            own = slice(self.start[i], self.start[i + 1])
            at[i] = n = kinds.setdefault(self.code[own].tobytes() + self.weight[own].tobytes(), len(first))
            if n == len(first):
                first.append(i)
        if len(first) == len(self.ids):
            return None
        held, size = pa.table({"at": pa.array(at), "query_id": self.ids}), np.diff(self.start)[first]
        take = spans(self.start[:-1][first], size)
        self.ids, self.code, self.weight = pa.array(range(len(first)), pa.int64()), self.code[take], self.weight[take]
        self.start, self.norm, self.floor = np.append(0, np.cumsum(size)), self.norm[first], self.floor[first]
        return held

    def sorted_by_reach(self) -> Asked:
        """In the order of the length that a text must have; the queries without a bound come first."""
        order = np.argsort(self.floor / np.maximum(self.norm, 1e-300), kind="stable")
        size = np.diff(self.start)[order]
        take = spans(self.start[:-1][order], size)
        self.ids, self.code, self.weight = self.ids.take(pa.array(order)), self.code[take], self.weight[take]
        self.start, self.norm, self.floor = np.concatenate([[0], np.cumsum(size)]), self.norm[order], self.floor[order]
        self.loose = int((self.floor <= 0).sum())
        return self

    def fit(self) -> Asked:
        """Groups of terms: any give right bounds, these give close ones."""
        order = np.argsort(-np.bincount(self.code, self.weight**2, len(self.terms)), kind="stable")
        n, single = np.arange(len(order)), GROUPS // 2
        self.group = np.empty(len(order), dtype=np.int32)
        self.group[order] = n if len(n) <= GROUPS else np.where(n < single, n, single + (n - single) % (GROUPS - single))
        return self

    def lengths(self, code: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of rows in each group."""
        rows, width = len(start) - 1, min(GROUPS, max(1, len(self.terms)))
        out = np.empty((rows, width), dtype=np.float32)
        for at in range(0, rows, TEXTS):
            e = min(at + TEXTS, rows)
            own = slice(start[at], start[e])
            key = np.repeat(np.arange(e - at), np.diff(start[at : e + 1])) * width + self.group[code[own]]
            out[at:e] = np.sqrt(np.bincount(key, weight[own] ** 2, (e - at) * width)).reshape(-1, width)
        return out

    @cached_property
    def rows(self) -> np.ndarray:
        """For the product with ``columns`` of texts, which is the bound of a score less the query's floor."""
        n = self.loose
        held = self.lengths(self.code[self.start[n] :], self.weight[self.start[n] :], self.start[n:] - self.start[n])
        return np.column_stack([held, SLACK * self.norm[n:], -self.floor[n:]]).astype(np.float32)

    def columns(self, code: np.ndarray, weight: np.ndarray, start: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return np.column_stack([self.lengths(code, weight, start), norm, np.ones(len(norm))]).astype(np.float32)


class Texts:
    """Some texts, held densely over the terms that occur in them."""

    def __init__(self, asked: Asked, code: np.ndarray, weight: np.ndarray, start: np.ndarray):
        local, col = np.unique(code, return_inverse=True)
        self.asked, self.at = asked, np.full(len(asked.terms), len(local), dtype=np.int32)
        self.at[local] = np.arange(len(local))
        self.width = len(local) + 1
        self.cells = np.zeros((len(start) - 1) * self.width)
        np.add.at(self.cells, np.repeat(np.arange(len(start) - 1), np.diff(start)) * self.width + col, weight)

    def products(self, text: np.ndarray, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of pairs of texts and queries."""
        a, out = self.asked, np.zeros(len(text))
        size = np.diff(a.start)[query]
        ends = np.cumsum(size)
        at = 0
        while at < len(text):
            e = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, side="right")))
            n = size[at:e]
            take = spans(a.start[query[at:e]], n)
            v = self.cells[self.at[a.code[take]] + np.repeat(text[at:e] * self.width, n)]
            v *= weight[take]
            out[at:e] = np.add.reduceat(v, np.cumsum(n) - n)
            at = e
        return out


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every span, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def coded(b: pa.RecordBatch, terms: pa.Array, weights: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a batch have terms that are asked for, and their codes, weights and bounds."""
    code = pc.index_in(b.column("t").flatten(), value_set=terms)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(b.num_rows), np.diff(b.column("t").offsets.to_numpy()))[known]
    weight = b.column("w").flatten().to_numpy(zero_copy_only=False)[known] if weights else np.ones(len(of))
    start = np.flatnonzero(np.diff(of, prepend=-1))
    return of[start], code.drop_null().to_numpy().astype(np.int32), weight, np.append(start, len(of))


def recoded(q: DataFrame, lists: DataFrame) -> DataFrame:
    """Terms (query_id, term, ...) as codes, where the lists hold codes; terms that no list has are left out."""
    if is_lists(q) or (terms := terms_of(lists)) is None:
        return q
    return q.join(small(terms, VOCABULARY), "term").drop("term").withColumnRenamed("code", "term")


def asked_of(part: DataFrame) -> Asked:
    """The queries of (query_id, term, weight), whose terms are coded where they are read, or of (query_id, t, w)."""
    if is_lists(part):
        return Asked.of_lists(part.select("query_id", "t", "w").toArrow())
    kind = pa.int32() if isinstance(part.schema["term"].dataType, T.IntegerType) else pa.string()
    terms = pa.array(np.sort(part.select("term").distinct().toArrow()["term"].to_numpy()), kind)
    sent = part.sparkSession.sparkContext.broadcast(terms)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pc.index_in(b.column("term"), value_set=sent.value), b.column("weight")], names=["query_id", "code", "weight"])

    kind = T.StructType([part.schema["query_id"], T.StructField("code", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    return Asked(part.select("query_id", "term", "weight").mapInArrow(kernel, kind).toArrow().to_pandas(), terms)


def size_of(q: DataFrame) -> int:
    """Terms of the queries, in either form."""
    return q.agg(F.sum(F.size("t"))).first()[0] or 0 if is_lists(q) else q.count()


def block(q: DataFrame, n: int, blocks: int) -> DataFrame:
    return q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)


def set_floors(asked: Asked, lists: DataFrame, k: int) -> None:
    """For each query a score that its k-th best text has at least: the k-th best among the longest texts, 0 if fewer share a term.

    Weights of 0 or less leave all floors at 0.
    """
    s = lists.sparkSession
    sized = lists
    n = lists.agg(F.count(F.lit(1)).alias("rows"), F.min("m").alias("least")).first()
    if not n["rows"] or not len(asked.ids) or n["least"] is None or n["least"] <= 0 or not (asked.weight > 0).all():
        return
    if n["rows"] > LONGEST:
        cut = sized.agg(F.percentile_approx("n", 1 - LONGEST / n["rows"], 10_000)).first()[0]
        sized = sized.where(F.col("n") >= cut)
    terms = s.sparkContext.broadcast(asked.terms)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, c, w, start = coded(b, terms.value)
            yield pa.RecordBatch.from_arrays([_lists(np.diff(start), pa.array(c)), _lists(np.diff(start), pa.array(w))], names=["c", "w"])

    top = sized.select("t", "w").limit(2 * LONGEST).mapInArrow(code, "c array<int>, w array<double>").toArrow().combine_chunks()
    if not top.num_rows:
        return
    size = pc.list_value_length(top["c"]).to_numpy()
    c, w = top["c"].combine_chunks().flatten().to_numpy(), top["w"].combine_chunks().flatten().to_numpy()
    ends = np.append(0, np.cumsum(size))
    order = np.argsort(-np.sqrt(np.add.reduceat(w**2, ends[:-1])), kind="stable")
    take = spans(ends[:-1][order], size[order])
    sent = s.sparkContext.broadcast((asked, c[take], w[take], size[order]))
    parts = max(1, min(len(asked.ids) // 50, 2 * s.sparkContext.defaultParallelism))
    found = s.range(0, len(asked.ids), 1, parts).mapInArrow(_floors(sent, k), "at long, floor double").toArrow().to_pandas()
    asked.floor[found["at"].to_numpy()] = found["floor"].to_numpy()


def _floors(sent, k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c, w, size = sent.value
        ends = np.append(0, np.cumsum(size))
        step = max(k, 6 * CELLS // max(1, len(np.unique(c))))
        for b in batches:
            ids, best = b.column(0).to_numpy(), []
            for n in range(0, len(size), step):  # texts held densely
                few = size[n : n + step]
                local, row = np.unique(c[ends[n] : ends[n + len(few)]], return_inverse=True)
                at = np.full(len(a.terms), -1, dtype=np.int32)
                at[local] = np.arange(len(local))
                cells = np.zeros((len(local), len(few)), dtype=np.float32)
                cells[row, np.repeat(np.arange(len(few)), few)] = w[ends[n] : ends[n + len(few)]]
                held = np.zeros((len(ids), min(k, len(few))))
                for m, i in enumerate(ids):
                    own = slice(a.start[i], a.start[i + 1])
                    r = at[a.code[own]]
                    if (r >= 0).any():
                        s = a.weight[own][r >= 0].astype(np.float32) @ cells[r[r >= 0]]
                        held[m] = np.partition(s, len(s) - held.shape[1])[len(s) - held.shape[1] :]
                best.append(held)
            best = np.concatenate(best, axis=1)
            out = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] >= k else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.maximum(0, out * (1 - 1e-4) - 1e-5))], names=["at", "floor"])

    return kernel


def search(sent, k: int, names: list[str]):
    """Batches of posting lists to (query_id, id, score): whatever may be among the k best of a query, ties at the edge included."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        floor = a.floor.copy()
        for b in batches:
            if not len(a.ids):
                continue
            of, code, weight, start = coded(b, a.terms)
            if not len(of):
                continue
            ids = b.column("id").take(pa.array(of))
            for qi, di, s in _loose(a, code, weight, start, k):
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(qi)), ids.take(pa.array(di)), pa.array(s)], names=names)
            if a.loose < len(a.ids):
                for qi, di, s in _bounded(a, code, weight, start, floor, k):
                    yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(qi)), ids.take(pa.array(di)), pa.array(s)], names=names)

    return kernel


def _bounded(a: Asked, code: np.ndarray, weight: np.ndarray, start: np.ndarray, floor: np.ndarray, k: int):
    """Pairs whose bound reaches the floor; a floor rises where a block of texts has k better ones."""
    size = np.diff(start)
    norm = np.sqrt(np.add.reduceat(weight**2, start[:-1]))
    order = np.argsort(-norm, kind="stable")
    reach = a.floor[a.loose :] / a.norm[a.loose :]
    at = 0
    while at < len(order):
        few = order[at : at + TEXTS]
        few = few[: max(16, CELLS // max(1, min(len(a.terms), int(size[few].sum()))))]
        at += len(few)
        last = int(np.searchsorted(reach, norm[few[0]] * (1 + SLACK), side="right"))
        if not last:
            return  # the rest is shorter still
        take = spans(start[:-1][few], size[few])
        c, w, st = code[take], weight[take], np.concatenate([[0], np.cumsum(size[few])])
        columns, texts, found = a.columns(c, w, st, norm[few]), Texts(a, c, w, st), []
        for n in range(0, last, QUERIES):
            bound = columns @ a.rows[n : min(n + QUERIES, last)].T
            hit = np.flatnonzero(bound.ravel() >= 0)
            di, qi = hit // bound.shape[1], hit % bound.shape[1] + n + a.loose
            s = texts.products(di, qi, a.weight)
            keep = (s > 0) & (s >= floor[qi])
            found.append((qi[keep], few[di[keep]], s[keep]))
        qi, di, s = map(np.concatenate, zip(*found))
        if not len(qi):
            continue
        o = np.lexsort((-s, qi))
        first = np.flatnonzero(np.diff(qi[o], prepend=-1))
        full = first[np.diff(np.append(first, len(o))) >= k]
        floor[qi[o][full]] = np.maximum(floor[qi[o][full]], s[o][full + k - 1] - 2 * 10.0**-DIGITS)
        keep = s >= floor[qi]
        yield qi[keep], di[keep], s[keep]


def overlaps(sent):
    """Batches of posting lists to (query_id, id, hits): how many of a query's terms a text has, for the pairs that are sent."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ids, first, query = sent.value
        for b in batches:
            at = pc.index_in(b.column("id"), value_set=ids)
            b = b.filter(pc.is_valid(at))
            of, code, weight, start = coded(b, a.terms, weights=False)
            if not len(of):
                continue
            at = at.drop_null().to_numpy()[of]
            for n in range(0, len(of), 64):
                e = min(n + 64, len(of))
                size = first[at[n:e] + 1] - first[at[n:e]]
                di, qi = np.repeat(np.arange(e - n), size), query[spans(first[at[n:e]], size)]
                s = Texts(a, code[start[n] : start[e]], weight[start[n] : start[e]], start[n : e + 1] - start[n]).products(di, qi, a.weight)
                some = np.flatnonzero(s > 0)
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(qi[some])), b.column("id").take(pa.array(of[n + di[some]])), pa.array(s[some].astype(np.int64))], names=["query_id", "id", "hits"])

    return kernel


def hits(q: DataFrame, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id``, ``id``, ``hits`` of pairs that share a term, by one scan of the lists. ``q``: distinct query_id, term, or query_id, t, w;
    ``pairs``: query_id, id."""
    asked = asked_of(q if is_lists(q) else recoded(q, lists).withColumn("weight", F.lit(1.0)))
    asked.weight = np.ones_like(asked.weight)
    p = pairs.toArrow().to_pandas()
    qi = pd.Index(asked.ids.to_pandas()).get_indexer(p["query_id"])
    p = p[(qi >= 0) & p["id"].notna()].assign(qi=qi[(qi >= 0) & p["id"].notna()])
    row, ids = pd.factorize(p["id"])
    order = np.argsort(row, kind="stable")
    first = np.searchsorted(row[order], np.arange(len(ids) + 1))
    kind = T.StructType([q.schema["query_id"], pairs.schema["id"], T.StructField("hits", T.LongType())])
    held = pa.array(ids, pairs.select("id").limit(0).toArrow().schema.field("id").type)
    sent = q.sparkSession.sparkContext.broadcast((asked, held, first, p["qi"].to_numpy()[order]))
    return lists.select("id", "t").mapInArrow(overlaps(sent), kind)


def _loose(a: Asked, code: np.ndarray, weight: np.ndarray, start: np.ndarray, k: int):
    """Queries without a floor: products with all texts, of which k of each 500 texts go on."""
    for n in range(0, a.loose, LOOSE_BLOCK):
        m = min(n + LOOSE_BLOCK, a.loose)
        own = slice(a.start[n], a.start[m])
        terms, row = np.unique(a.code[own], return_inverse=True)
        matrix = np.zeros((len(terms), m - n))
        matrix[row, np.repeat(np.arange(m - n), np.diff(a.start[n : m + 1]))] = a.weight[own]
        shared = np.zeros((len(terms), m - n), dtype=np.float32)
        shared[row, np.repeat(np.arange(m - n), np.diff(a.start[n : m + 1]))] = 1
        to = np.full(len(a.terms), -1, dtype=np.int32)
        to[terms] = np.arange(len(terms))
        for at in range(0, len(start) - 1, 500):
            ends = start[at : at + 501]
            r, w = to[code[ends[0] : ends[-1]]], weight[ends[0] : ends[-1]]
            doc = np.repeat(np.arange(at, at + len(ends) - 1), np.diff(ends))[r >= 0]
            w, r = w[r >= 0], r[r >= 0]
            if not len(r):
                continue
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            s = sums(matrix, r, w, first).T
            has = s > 0 if (matrix >= 0).all() and w.min() > 0 else sums(shared, r, None, first).T > 0
            v = np.where(has, np.round(s, DIGITS), -np.inf)
            keep = has if v.shape[1] <= k else has & (v >= np.partition(v, -k, axis=1)[:, -k][:, None])
            qi, di = np.nonzero(keep)
            yield qi + n, doc[first][di], s[qi, di]


def sums(matrix: np.ndarray, row: np.ndarray, w: np.ndarray | None, start: np.ndarray) -> np.ndarray:
    """Rows of the matrix, times ``w``, summed from each start to the next; a few texts at a time, which stay in the cache."""
    out, ends = np.empty((len(start), matrix.shape[1])), np.append(start, len(row))
    for a in range(0, len(start), 4):
        e = min(a + 4, len(start))
        part = matrix[row[ends[a] : ends[e]]]
        if w is not None:
            part *= w[ends[a] : ends[e], None]
        np.add.reduceat(part, start[a:e] - start[a], axis=0, out=out[a:e])
    return out
