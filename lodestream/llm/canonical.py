"""Mapping of freely typed values to the entries of a reference list.

Distinct values only are looked up, however often each occurs. First an automaton over all names and aliases
finds the mentions embedded in a value; of mentions that don't overlap the longest wins. All other values, and
values of which words are left that may belong to a longer name, go to token-set similarity: the words of
value and name, in any order, each with a tolerance for typing errors that grows with its length, found over
an inverted index of words and their deletion neighbourhoods. Words weigh by how rare they are among the
values (inverse document frequency over all distinct values), so that what people put round any name (city,
district, a state) counts little without being listed anywhere.

    similarity = weight of the name's words that are matched, less for errors / weight of all words of name and value

A name that is typed in one word, or a word typed in two, is matched too. A value that is equally near to
several entries means none of them; nor does one below ``least``.

The list goes to the tasks in blocks of ``BLOCK`` names, each compared with all distinct values; a list of one
block is broadcast, further blocks are tasks of their own. No list is too long, and the result is the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import durable, small

#: Names compared in one task, which bounds the index there.
BLOCK = 20_000
#: Lengths of a word from which it may hold one, two, three typing errors.
TOLERANT = (4, 8, 15)
#: Letters of a word beyond which it is compared itself rather than by its deletion neighbourhood.
LONG, TOLERANCE = 32, len(TOLERANT)
#: Similarity from which a name is meant, and the share of a word's weight that errors in all of its letters would cost.
LEAST, COST = 0.4, 0.5


def fold(s: str) -> str:
    """Compatibility form, lower case, combining accents of Latin letters off, all but letters, marks and digits to one space."""
    s = unicodedata.normalize("NFKC", s).casefold()
    s = "".join(ch for ch in unicodedata.normalize("NFD", s) if not "̀" <= ch <= "ͯ" and unicodedata.category(ch) != "Cf")
    s = unicodedata.normalize("NFC", s)
    return " ".join("".join(ch if unicodedata.category(ch)[0] in "LMN" else " " for ch in s).split())


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours from a to b; most+1 if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def tolerance(word: str) -> int:
    return sum(len(word) >= n for n in TOLERANT)


def deletions(s: str, most: int) -> set[str]:
    """s with up to ``most`` characters left out."""
    out = layer = {s}
    for _ in range(most):
        layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
        out = out | layer
    return out


class Gazetteer:
    """A block of the list. ``names``: (entry, folded name, weight of each of its words)."""

    def __init__(self, names: Sequence[tuple[int, str, Sequence[float]]]):
        import ahocorasick

        self.entries: dict[str, set[int]] = {}
        self.weight: dict[str, list[float]] = {}
        for entry, key, weights in names:
            self.entries.setdefault(key, set()).add(entry)
            self.weight[key] = list(weights)
        self.auto = ahocorasick.Automaton()
        for key in self.entries:
            self.auto.add_word(f" {key} ", key)
        if self.entries:
            self.auto.make_automaton()
        # The inverted index: from a word, with letters left out, to the word, and from there to the names that hold it.
        self.near: dict[str, set[str]] = {}
        self.holding: dict[str, set[str]] = {}
        for key in self.entries:
            for w in {*key.split(), key.replace(" ", "")}:
                self.holding.setdefault(w, set()).add(key)
        self.long = [w for w in self.holding if len(w) > LONG]
        for w in self.holding:
            if len(w) <= LONG:
                for d in deletions(w, tolerance(w)):
                    self.near.setdefault(d, set()).add(w)

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and name of the longest mentions that don't overlap, in order."""
        if not self.entries:
            return []
        found = [(end - 1 - len(key), end - 1, key) for end, key in self.auto.iter(f" {text} ")]
        out: list[tuple[int, int, str]] = []
        for a, b, key in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, key))
        return sorted(out)

    def like(self, word: str) -> dict[str, int]:
        """Indexed words that ``word`` may be, with their errors."""
        most, found = tolerance(word), {}
        short = {w for d in deletions(word, most) for w in self.near.get(d, ())} if len(word) <= LONG + TOLERANCE else set()
        for w in short.union(self.long):
            allowed = max(most, tolerance(w))
            n = edits(word, w, allowed)
            if n <= allowed:
                found[w] = n
        return found

    def scored(self, words: Sequence[str], weights: Sequence[float], least: float) -> dict[str, float]:
        """Names of at least that similarity. A word may be typed in two, and a name in one."""
        variants = [(list(words), list(weights))]
        for k in range(len(words) - 1):  # a word typed in two is as rare as its rarer part
            variants.append(([*words[:k], words[k] + words[k + 1], *words[k + 2 :]], [*weights[:k], max(weights[k : k + 2]), *weights[k + 2 :]]))
        best: dict[str, float] = {}
        known: dict[str, dict[str, int]] = {}
        for ws, vs in variants:
            total = sum(vs)
            hits = []
            for w in ws:
                if w not in known:
                    known[w] = self.like(w)
                hits.append(known[w])
            for key in {key for h in hits for w in h for key in self.holding[w]}:
                own = key.split()
                for parts, part_weights in ((own, self.weight[key]), ([key.replace(" ", "")], [sum(self.weight[key])])):
                    got, used = 0.0, set()
                    gone = 0.0
                    for p, pw in sorted(zip(parts, part_weights), key=lambda x: -x[1]):
                        at = min(((h[p], i) for i, h in enumerate(hits) if p in h and i not in used), default=None)
                        if at:
                            used.add(at[1])
                            got += pw * (1 - COST * at[0] / max(len(p), 1))
                            gone += vs[at[1]]
                    s = got / max(sum(part_weights) + total - gone, 1e-9)
                    if s >= least and s > best.get(key, 0.0):
                        best[key] = s
                    if len(own) == 1:
                        break
        return best

    def candidates(self, text: str, weights: Sequence[float], least: float) -> list[tuple[str, int, float]]:
        """(name, letters of its mention or 0, similarity) of the names that ``text`` may mean. Exact names come alone."""
        if text in self.entries:
            return [(text, len(text), 2.0)]
        spans = {key: b - a for a, b, key in self.mentions(text)}
        words = text.split()
        for k in range(len(words) - 1):  # a name of which a word is typed in two
            one = " ".join([*words[:k], words[k] + words[k + 1], *words[k + 2 :]])
            spans |= {key: b - a for a, b, key in self.mentions(one)}
        # Of a value with mentions all names count that hold one, as a longer name may be meant with errors.
        found = self.scored(text.split(), weights, 0.0 if spans else least)
        out = [(key, spans.get(key, 0), s) for key, s in found.items() if s >= least or key in spans]
        return out + [(key, n, 0.0) for key, n in spans.items() if key not in found]


def decide(found: Sequence[tuple[str, int, float, Sequence[int]]]) -> tuple[int, str]:
    """Entry, or 0, and how it was found (exact, mention, similar, ambiguous, none) from the candidates of all blocks."""
    if not found:
        return 0, "none"
    longest = max(n for _, n, _, _ in found)
    how = "similar"
    if longest:
        how = "exact" if any(s > 1.5 for _, _, s, _ in found) else "mention"
        named = [set(key.split()) for key, n, _, _ in found if n == longest]
        found = [f for f in found if any(x <= set(f[0].split()) for x in named)]
        if how == "exact":
            found = [f for f in found if f[2] > 1.5]
    top = max(round(s, 9) for _, _, s, _ in found)
    ids = {e for _, _, s, es in found if round(s, 9) == top for e in es}
    return (min(ids), how) if len(ids) == 1 else (0, "ambiguous")


def _folded(df: DataFrame, cols: str) -> DataFrame:
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[fold(v) for v in b["value"]])

    return df.mapInPandas(kernel, f"{cols}, text string")


def map_values(df: DataFrame, id_col: str, col: str, ref: DataFrame, entry_col: str, name_cols: Sequence[str], least: float = LEAST) -> DataFrame:
    """``id_col``, ``entry`` (BIGINT, 0 where no entry is meant) and ``how`` for every row whose value isn't null.

    ``ref``: ``entry_col`` and the columns of names; null and blank names are none, an entry given twice is one. Empty
    and blank values, values of no letters or digits, and all values over an empty list mean none.
    """
    rows = df.select(F.col(id_col), F.col(col).alias("__ls_value")).where(F.col(col).isNotNull())
    values = durable(_folded(rows.select(F.col("__ls_value").alias("value")).distinct(), "value string"))
    listed = ref.select(F.col(entry_col).cast("long").alias("entry"), F.explode(F.array(*[F.col(c).cast("string") for c in name_cols])).alias("value")).dropna().distinct()
    listed = durable(_folded(listed, "entry long, value string").where("text <> ''").select("entry", "text").distinct())
    # Weights: in how many of all distinct values (by their folded form) a word stands.
    texts = values.select("text").where("text <> ''").distinct()
    total = texts.count()
    df_of = texts.select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    df_of = small(durable(df_of))

    def weighed(t: DataFrame, keys: list[str]) -> DataFrame:
        each = t.select(*keys, F.posexplode(F.split("text", " ")).alias("at", "w")).join(df_of, "w", "left")
        weight = F.log((F.lit(float(total)) + 2.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 0.1
        g = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", weight.alias("weight")))).alias("x"))
        return g.select(*keys, F.col("x.weight").alias("weights"))

    names = durable(weighed(listed, ["entry", "text"]))
    asked = weighed(texts, ["text"])
    blocks = max(1, -(-names.count() // BLOCK))
    schema = "text string, name string, letters int, score double, entries array<bigint>"

    def compare(g: Gazetteer, texts: Sequence[str], weights: Sequence[Sequence[float]]) -> pa.RecordBatch:
        out = [(t, key, n, s, sorted(g.entries[key])) for t, w in zip(texts, weights) for key, n, s in g.candidates(t, w, least)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["text", "name", "letters", "score", "entries"])

    if blocks == 1:
        t = names.toArrow()
        sent = df.sparkSession.sparkContext.broadcast(list(zip(*(t.column(c).to_pylist() for c in ("entry", "text", "weights")))))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = None
            for b in batches:
                g = g or Gazetteer(sent.value)
                yield compare(g, b.column("text").to_pylist(), b.column("weights").to_pylist())

        found = asked.mapInArrow(kernel, schema)
    else:

        def block(key, left: pa.Table, right: pa.Table) -> pa.Table:
            g = Gazetteer(list(zip(*(right.column(c).to_pylist() for c in ("entry", "text", "weights")))))
            return pa.Table.from_batches([compare(g, left.column("text").to_pylist(), left.column("weights").to_pylist())])

        split = names.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))
        every = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = every.groupBy("block").cogroup(split.groupBy("block")).applyInArrow(block, schema)

    @F.pandas_udf("entry bigint, how string")
    def settled(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide([(x["name"], x["letters"], x["score"], x["entries"]) for x in f]) for f in found], columns=["entry", "how"])

    best = found.groupBy("text").agg(F.collect_list(F.struct("name", "letters", "score", "entries")).alias("found"))
    best = best.select("text", settled("found").alias("d")).select("text", "d.entry", "d.how")
    meant = values.join(best, "text", "left").select(F.col("value").alias("__ls_value"), F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("how", F.lit("none")).alias("how"))
    return rows.join(small(durable(meant)), "__ls_value").select(id_col, "entry", "how")


__all__ = ["Gazetteer", "decide", "deletions", "edits", "fold", "map_values", "tolerance"]
