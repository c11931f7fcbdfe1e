"""Subject areas of documents, from a factorised document-term matrix with anchored components.

Terms are words and pairs of neighbouring words (numbers masked). The document-term matrix of hand-labelled
documents is factored into document weights and component profiles by alternating multiplicative updates that
keep everything non-negative (for the Kullback-Leibler divergence). One component is anchored to each subject:
its profile starts from the terms that documents labelled with it prefer, and has zeros, which the updates
keep, at terms of no such document and at terms that all subjects share. A free component, in every document,
takes up what belongs to no subject. A document has weight on its own labels and the free component only;
that some labels are wrong shows in how firmly a term belongs to a subject, the share of its mass there.

Then every sentence of every document is folded in: under the fixed profiles, the same updates give its weights
on the components, each the number of its terms which that component explains. A sentence deals with the
subject of the largest weight if that is at least ``least`` terms and most of what subjects explain in it; a
figure of speech has one such word, not several. Sentences of fewer than ``words`` words (list entries,
headings) deal with nothing.

The fit reads at most ``sample`` labelled documents (a classifier's bounded sample, chosen by a hash of the id)
in one task. Its profiles are a table of (word, next word, subject, profile, firmness), of firm terms only, so what is
sent to the tasks is bounded by the sample and not by the corpus or the number of subjects. All documents are
read once, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.runtime import durable


@dataclass(frozen=True)
class Model:
    """sample: labelled documents that the fit reads at most; rounds: alternating updates; cap: most that one term counts
    in a document; seen: labelled documents that a term must be in; spread: a term whose largest share among the
    subjects stays below is nobody's; prior: counts against a term's firmness; firm: firmness of evidence; folds: updates
    of a sentence's weights; least, words, share: see the module and the query."""

    sample: int = 20_000
    rounds: int = 12
    cap: int = 4
    seen: int = 2
    spread: float = 0.5
    prior: float = 1.0
    firm: float = 0.5
    folds: int = 4
    least: float = 2.5
    words: int = 4
    share: float = 0.25
    slice: int = 2000


def _tokens() -> Callable[[str], list[str]]:
    """Words, numbers and ends of sentences of a text in small letters, in one scan."""
    import regex

    return regex.compile(r"\p{N}+|[\p{L}\p{M}]+|[.!?।](?=\s)|\n|(?<=\s)•(?=\s)").findall


def numbered(texts: Sequence[str | None], number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts by their numbers (0 or more; -1 unknown; -2 ends a sentence), and each word's text and sentence."""
    find, ids, size = _tokens(), [], []
    for t in texts:
        found = find(t.lower()) if t else []
        ids += map(number, found)
        ids.append(-2)
        size.append(len(found) + 1)
    ids = np.array(ids, dtype=np.int64)
    of = np.repeat(np.arange(len(size)), size)
    ends = ids == -2
    sentence = np.cumsum(ends) - ends
    return ids[~ends], of[~ends], sentence[~ends]


def _kind(token: str) -> str:
    """A number is '#', the end of a sentence is empty."""
    c = token[0]
    return "#" if c.isdigit() or c.isnumeric() else "" if c in ".!?।\n•" else token


class Terms:
    """Numbers words as they come."""

    def __init__(self):
        self.known: dict[str, int] = {"#": 0}

    def __call__(self, token: str) -> int:
        k = _kind(token)
        return self.known.setdefault(k, len(self.known)) if k else -2


def document_terms(ids: np.ndarray, of: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms (word * (size+1) + next word + 1, or word * (size+1) for the word alone; a number alone is none) and their texts."""
    near = (sentence[1:] == sentence[:-1]) if len(ids) else np.zeros(0, bool)
    single = ids > 0
    pair = np.flatnonzero(near)
    return np.concatenate([ids[single] * (size + 1), ids[pair] * (size + 1) + ids[pair + 1] + 1]), np.concatenate([of[single], of[pair]])


def factor(doc: np.ndarray, term: np.ndarray, n: np.ndarray, labels: list[list[int]], subjects: int, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Term, component (``subjects`` is the free one), profile and firmness of each cell of the profiles, and the divergence by round.

    The matrix is given by cells (doc, term, n). The weights of a document are on its labels and the free component.
    """
    count, width = len(labels), subjects + 1
    terms, t = np.unique(term, return_inverse=True)
    lab_doc = np.repeat(np.arange(count), [len(x) for x in labels])
    lab = np.array([k for x in labels for k in x], dtype=np.int64)
    each = np.array([len(x) for x in labels])
    # Every cell of the matrix once per component that its document may have.
    first = np.cumsum(each) - each
    reps = each[doc] + 1
    cell = np.repeat(np.arange(len(doc)), reps)
    start = np.cumsum(reps) - reps
    at = np.arange(len(cell)) - start[cell]
    own = at < each[doc][cell]
    comp = np.full(len(cell), subjects)
    comp[own] = lab[(first[doc][cell] + at)[own]]
    pairs, h_at = np.unique(t[cell] * width + comp, return_inverse=True)
    h_term, h_comp = pairs // width, pairs % width
    w_pairs, w_at = np.unique(doc[cell] * width + comp, return_inverse=True)
    is_free = h_comp == subjects
    # Seeds: documents of a subject that have the term, per document of the subject, against all subjects.
    size = np.bincount(lab, minlength=subjects).astype(float)
    weight = 1 / np.maximum(each, 1)
    has = np.bincount(h_at, weights=np.where(own, weight[doc][cell], 0.0), minlength=len(pairs))
    rate = np.where(is_free, 0, has / np.maximum(np.append(size, 1)[h_comp], 1))
    total = np.bincount(h_term, weights=rate, minlength=len(terms))
    prefer = rate / np.maximum(total[h_term], 1e-12)
    top = np.zeros(len(terms))
    np.maximum.at(top, h_term, prefer)
    base = np.bincount(t, weights=n, minlength=len(terms))
    h = base[h_term] * np.where(is_free, 0.3, np.where(top[h_term] < m.spread, 0.0, prefer**2))

    def normal(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.bincount(h_comp, weights=x, minlength=width), 1e-12)[h_comp]

    h, w = normal(h), np.ones(len(w_pairs))
    amount = np.bincount(doc, weights=n, minlength=count)
    w *= amount[w_pairs // width] / np.bincount(w_pairs // width, minlength=count)[w_pairs // width]
    divergence, w_comp = [], w_pairs % width

    def shares() -> tuple[np.ndarray, np.ndarray]:
        """What each component explains of each cell, and all that is explained."""
        r = w[w_at] * h[h_at]
        explained = np.maximum(np.add.reduceat(r, start), 1e-300)
        return r * (n / explained)[cell], explained

    for _ in range(m.rounds):
        w = np.bincount(w_at, weights=shares()[0], minlength=len(w_pairs))
        r, explained = shares()
        divergence.append(float(w.sum() - n.sum() + (n * np.log(n / explained)).sum()))
        mass = np.bincount(h_at, weights=r, minlength=len(pairs))
        grown = np.bincount(h_comp, weights=mass, minlength=width) / np.maximum(np.bincount(w_comp, weights=w, minlength=width), 1e-12)
        h, w = normal(mass), w * grown[w_comp]
    whole = np.bincount(h_term, weights=mass, minlength=len(terms))
    return terms[h_term], h_comp, h, mass / (whole[h_term] + m.prior), divergence


PROFILE = T.StructType([T.StructField("word", T.StringType()), T.StructField("next", T.StringType()), T.StructField("subject", T.IntegerType()), T.StructField("profile", T.DoubleType()), T.StructField("firmness", T.DoubleType())])


def fit(texts: Sequence[str | None], labels: list[list[int]], subjects: int, m: Model) -> pa.Table:
    """The profiles of firm terms, as rows of PROFILE; ``subject`` is null for the free component's part of such a term."""
    number = Terms()
    ids, of, sentence = numbered(texts, number)
    size = len(number.known)
    term, of = document_terms(ids, of, sentence, size)
    codes, t = np.unique(term, return_inverse=True)
    cells, n = np.unique(of * max(len(codes), 1) + t, return_counts=True)
    doc, t = cells // max(len(codes), 1), cells % max(len(codes), 1)
    often = np.bincount(t, minlength=len(codes)) >= m.seen
    keep = often[t]
    doc, t, n = doc[keep], t[keep], np.minimum(n[keep], m.cap).astype(float)
    if not len(doc):
        return pa.table({f.name: [] for f in PROFILE}).cast(pa.schema([("word", pa.string()), ("next", pa.string()), ("subject", pa.int32()), ("profile", pa.float64()), ("firmness", pa.float64())]))
    code, comp, h, firmness, _ = factor(doc, codes[t], n, labels, subjects, m)
    firm = np.unique(code[(firmness >= m.firm) & (comp < subjects)])
    keep = np.isin(code, firm) & (h > 0)
    code, comp, h, firmness = code[keep], comp[keep], h[keep], firmness[keep]
    names = np.array(list(number.known), dtype=object)
    second = code % (size + 1)
    return pa.table({
        "word": pa.array(names[code // (size + 1)], pa.string()),
        "next": pa.array([names[k - 1] if k else None for k in second], pa.string()),
        "subject": pa.array(comp.astype(np.int32), mask=comp == subjects),
        "profile": pa.array(h),
        "firmness": pa.array(firmness),
    })


class Folder:
    """Folds sentences in under fixed profiles."""

    def __init__(self, profiles: pa.Table, subjects: int, m: Model):
        self.m, self.free = m, subjects
        words, nexts = profiles.column("word").to_pylist(), profiles.column("next").to_pylist()
        self.known = {w: k for k, w in enumerate(["#", *sorted({w for w in (*words, *nexts) if w is not None} - {"#"})])}
        size = self.size = len(self.known)
        code = np.array([self.known[a] * (size + 1) + (0 if b is None else self.known[b] + 1) for a, b in zip(words, nexts)], dtype=np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, self.first, self.many = np.unique(code[order], return_index=True, return_counts=True)
        self.comp = profiles.column("subject").fill_null(subjects).to_numpy()[order].astype(np.int64)
        self.h = profiles.column("profile").to_numpy()[order]

    def __call__(self, token: str) -> int:
        k = _kind(token)
        return self.known.get(k, -1) if k else -2

    def weights(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each sentence with a firm term and each component: sentence, its text, its words, component, weight."""
        ids, of, sentence = numbered(texts, self)
        size = self.size
        long = np.bincount(sentence, weights=ids != 0, minlength=1)  # numbers aren't words
        text = np.zeros(len(long), np.int64)
        text[sentence] = of
        near = np.flatnonzero((sentence[1:] == sentence[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)) if len(ids) else np.zeros(0, np.int64)
        single = np.flatnonzero(ids >= 0)
        term = np.concatenate([ids[single] * (size + 1), ids[near] * (size + 1) + ids[near + 1] + 1])
        place = np.concatenate([sentence[single], sentence[near]])
        at = np.searchsorted(self.codes, term)
        hit = np.flatnonzero((at < len(self.codes)) & (self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == term)) if len(self.codes) else np.zeros(0, np.int64)
        at, place = at[hit], place[hit]
        reps = self.many[at]
        cell = np.repeat(np.arange(len(at)), reps)
        start = np.cumsum(reps) - reps
        entry = self.first[at][cell] + np.arange(len(cell)) - start[cell]
        comp, h = self.comp[entry], self.h[entry]
        pairs, w_at = np.unique(place[cell] * (self.free + 1) + comp, return_inverse=True)
        w = np.ones(len(pairs))
        for _ in range(self.m.folds if len(cell) else 0):
            r = w[w_at] * h
            r /= np.add.reduceat(r, start)[cell]
            w = np.bincount(w_at, weights=r, minlength=len(pairs))
        s = pairs // (self.free + 1)
        return s, text[s], long[s], pairs % (self.free + 1), w

    def tally(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, subject and sentences of each subject of each text."""
        s, text, long, comp, w = self.weights(texts)
        own = comp < self.free
        s, text, long, comp, w = s[own], text[own], long[own], comp[own], w[own]
        if not len(s):
            return (np.zeros(0, np.int64),) * 3
        order = np.lexsort((comp, -w, s))
        lead = order[np.flatnonzero(np.diff(s[order], prepend=-1))]
        whole = np.bincount(s, weights=w)[s[lead]]
        deals = lead[(w[lead] >= self.m.least) & (2 * w[lead] > whole) & (long[lead] >= self.m.words)]
        pairs, n = np.unique(text[deals] * self.free + comp[deals], return_counts=True)
        return pairs // self.free, pairs % self.free, n


def profiles_of(docs: DataFrame, id_col: str, text_col: str, given: DataFrame, subjects: int, m: Model) -> DataFrame:
    """The profiles as a table; ``given``: ``__ls_id``, labels ARRAY<INT>."""
    chosen = given.orderBy(F.xxhash64("__ls_id"), "__ls_id").limit(m.sample) if m.sample else given
    rows = docs.select(F.col(id_col).alias("__ls_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__ls_id")
    rows = rows.groupBy("__ls_id").agg(F.max("text").alias("text"), F.max("labels").alias("labels"))

    def kernel(t: pa.Table) -> pa.Table:
        order = np.argsort(np.array(t.column("__ls_h").to_pylist()), kind="stable")
        t = t.take(pa.array(order))
        return fit(t.column("text").to_pylist(), t.column("labels").to_pylist(), subjects, m)

    one = rows.select("text", "labels", F.xxhash64("__ls_id").alias("__ls_h"), F.lit(0).alias("__ls_one"))
    return one.groupBy("__ls_one").applyInArrow(kernel, PROFILE)


def subject_areas(docs: DataFrame, id_col: str, text_col: str, areas: DataFrame, labels: DataFrame, m: Model = Model()) -> DataFrame:
    """``id_col``, ``subject``, ``share``: the subjects of at least ``share`` of the sentences that deal with any subject.

    ``areas``: subject; ``labels``: ``id_col``, subject. Labels given twice count once; labels of unknown
    subjects or documents count nothing. Null, empty and blank texts have no subject; without any
    labels no document has one. A repeated row is one document; rows of one id with different texts each have
    their own subjects.
    """
    names = areas.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").toArrow().column("subject").to_pylist()
    subject = docs.sparkSession.createDataFrame(list(enumerate(names)), "k int, subject string") if names else None
    if subject is None:
        return docs.select(F.col(id_col), F.lit("").alias("subject"), F.lit(0.0).alias("share")).where(F.lit(False))
    given = labels.select(F.col(id_col).alias("__ls_id"), "subject").dropna().join(subject, "subject")
    given = durable(given.groupBy("__ls_id").agg(F.array_sort(F.collect_set("k")).alias("labels")))
    profiles = profiles_of(docs, id_col, text_col, given, len(names), m).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(profiles.to_pydict())
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])
    label, count = pa.array(names), len(names)
    plan = pa.schema([("word", pa.string()), ("next", pa.string()), ("subject", pa.int32()), ("profile", pa.float64()), ("firmness", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = None
        for b in batches:
            folder = folder or Folder(pa.table(sent.value, schema=plan), count, m)
            for at in range(0, b.num_rows, m.slice):
                part = b.slice(at, m.slice)
                text, k, n = folder.tally(part.column(1).to_pylist())
                share = n / np.maximum(np.bincount(text, weights=n, minlength=1)[text], 1) if len(n) else np.zeros(0)
                keep = np.flatnonzero(share >= m.share)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[keep])), label.take(pa.array(k[keep])), pa.array(share[keep])], names=schema.names)

    found = docs.select(F.col(id_col), F.col(text_col).alias("__ls_text")).where("__ls_text IS NOT NULL").mapInArrow(kernel, schema)
    return found.distinct()
