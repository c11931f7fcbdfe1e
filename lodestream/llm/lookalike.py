"""One form for texts that look the same but are stored with different characters.

A text is cut into words at white space. Words of plain characters are the vocabulary. Every other word goes,
as it is stored, through a weighted edit automaton that walks a trie of vocabulary words: a look-alike, a
compatibility form or another composition of the same letter costs nothing, an ignorable character costs
nothing, any other edit costs one. The cheapest spelling within ``most`` is canonical, the more frequent one of
several. Only words without such a spelling are normalised character by character from the table. The table
is the more careful of the two: letters of another script are read as Latin ones only in a word that has Latin
letters or digits besides, and letters that merely resemble Latin ones (``RESEMBLE``) never; a word wholly in
another script is that script's own unless the vocabulary knows the word it looks like.

Words meet the vocabulary in buckets of one class form, in which every character stands for all that cost
nothing against it; for ``most`` edits they meet under all class forms with up to that many characters left
out. So no spelling within ``most`` is missed, and neither vocabulary nor words are ever in one place.
Differences that a reader sees (case, digits, accents, raised digits, punctuation) are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import durable, small

# Letters of other scripts that look like Latin ones, and hyphens, each with what it looks like.
# Two readings: the first is taken by the table, the vocabulary may prefer the second.
LOOK_ALIKES = """
а a|е e|о o|р p|с c|у y|х x|і i|ѕ s|ј j|һ h|ԁ d|ԛ q|ԝ w|ѵ v|ӏ l I|к k|ї ï|ё ë
А A|В B|Е E|К K|М M|Н H|О O|Р P|С C|Т T|У Y|Х X|І I l|Ѕ S|Ј J|Ү Y|Ԍ G|Ԛ Q|Ԝ W|Ѵ V|Ӏ I l|Ї Ï|Ё Ë
ο o|ν v|ϲ c|ϳ j|κ k|ρ p|Α A|Β B|Ε E|Ζ Z|Η H|Ι I l|Κ K|Μ M|Ν N|Ο O|Ρ P|Τ T|Υ Y|Χ X|Ϲ C|Ϳ J|µ μ
օ o|ս u|հ h|ո n|Օ O|Ս U|Լ L|ɑ a|ɡ g|ꓲ I l|‐ -|‑ -|﹣ -
"""
# Letters that resemble Latin ones; only a word of the vocabulary makes them such.
RESEMBLE = """
α a|ι i|υ u|γ y|η n|τ t|ω w|σ o|ѡ w|ъ b|ь b|г r|п n|т t|м m|н h|в B
ı i|ɩ i|ʏ y|ᴏ o|ᴄ c|ꜱ s|ᴜ u|ᴠ v|ᴡ w|ᴢ z|ĸ k|ꞁ l|ǀ l I|ց g|զ q|ց g|գ q
Ꭺ A|Ᏼ B|Ꮯ C|Ꭰ D|Ꭼ E|Ꮐ G|Ꮋ H|Ꭻ J|Ꮶ K|Ꮮ L|Ꮇ M|Ꮲ P|Ꭱ R|Ꮪ S|Ꭲ T|Ꮩ V|Ꮃ W|Ꮓ Z
ꓐ B|ꓚ C|ꓓ D|ꓰ E|ꓝ F|ꓖ G|ꓧ H|ꓙ J|ꓗ K|ꓡ L|ꓟ M|ꓠ N|ꓳ O|ꓑ P|ꓣ R|ꓢ S|ꓔ T|ꓴ U|ꓦ V|ꓪ W|ꓫ X|ꓬ Y|ꓜ Z
"""
# Kinds of compatibility forms that look like the characters they stand for.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>"}
#: Buckets of words at least, and words of a bucket about at most, which bounds a trie.
BUCKETS, BUCKET_WORDS = 64, 20_000
#: Members of a class that meet all others in one task, beyond which the class is salted.
CLASS_PART = 4096


def _pairs(listed: str) -> dict[str, list[str]]:
    return {x.split()[0]: x.split()[1:] for line in listed.split("\n") for x in line.split("|") if x.strip()}


_LIKE, _RESEMBLE = _pairs(LOOK_ALIKES), _pairs(RESEMBLE)
_OTHER_SCRIPT = {ch for ch in _LIKE if unicodedata.category(ch)[0] == "L" and not unicodedata.name(ch).startswith(("LATIN", "MICRO")) and ch != "μ"}
_PLAIN = r"\x21-\x7Eऀ-नप-रलळव-ऻऽ-ॗॠ-ॿ"
#: Texts that match hold a character that has another form.
NOT_PLAIN = rf"[^\n {_PLAIN}]"
#: Whole words that aren't plain; possessive, so that long words cost one scan.
NOISY = rf"(?<!\S)[{_PLAIN}]*+\S+"
#: Blanks of all kinds.
BLANKS = "[" + "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs") + "]"
#: Stands in a text for a word that isn't plain; a text's own such character is never in a plain word.
HOLE = "\u0001"


@lru_cache(maxsize=100_000)
def readings(ch: str) -> tuple[str, ...]:
    """All that a character may be read as at no cost, the table's reading first; the empty string for an ignorable one."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or ch == "͏" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ("",)
    if ch in _LIKE:
        return tuple(unicodedata.normalize("NFD", x) for x in _LIKE[ch])
    if ch in _RESEMBLE:
        return (ch, *_RESEMBLE[ch])
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in SAME_LOOK:
        inner = "".join(chr(int(x, 16)) for x in parts[1:])
        if not (inner[0] == " " and len(inner) > 1):  # a spacing accent is no space
            return ("".join(readings(c)[0] for c in unicodedata.normalize("NFD", inner)),)
    if cat == "Zs":
        return (" ",)
    full = unicodedata.normalize("NFD", ch)
    if full != ch:
        return ("".join(readings(c)[0] for c in full),)
    return (ch,)


def _classes() -> dict[str, str]:
    """One representative for all single characters that cost nothing against one another."""
    up: dict[str, str] = {}

    def root(c: str) -> str:
        while c in up:
            c = up[c]
        return c

    for ch, to in (*_LIKE.items(), *_RESEMBLE.items()):
        own = [x for x in ((ch, *to) if ch in _RESEMBLE else to) if len(x) == 1]
        for a, b in zip(own, own[1:]):
            lo, hi = sorted({root(a), root(b)} | {root(a)})[0], max(root(a), root(b))
            if lo != hi:
                up[hi] = lo
    return {c: root(c) for c in up}


CLASS = _classes()


def class_form(word: str) -> str:
    """The word with one character for all that look alike, ignorable ones off; equal for words that differ at no cost."""
    first = "".join(readings(c)[0] for c in unicodedata.normalize("NFD", word))
    return "".join(CLASS.get(c, c) for c in unicodedata.normalize("NFD", first))


def mixed(word: str) -> bool:
    """Whether a word has Latin letters or digits of its own."""
    return any(r.isascii() and r.isalnum() for c in word if c not in _OTHER_SCRIPT for r in readings(c)[0])


def by_table(word: str) -> str:
    """The word with every character in its table form, composed."""
    keep = () if mixed(word) else _OTHER_SCRIPT
    return unicodedata.normalize("NFC", "".join(c if c in keep else readings(c)[0] for c in word))


def shorter(s: str, most: int) -> set[str]:
    """s with up to ``most`` characters left out."""
    out = layer = {s}
    for _ in range(most):
        layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
        out = out | layer
    return out


class Trie:
    """Vocabulary words by their decomposed characters, each with its frequency."""

    def __init__(self, words: Iterator[tuple[str, int]] = ()):
        self.root: dict = {}
        for w, n in words:
            self.add(w, n)

    def add(self, w: str, n: int) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", w):
            node = node.setdefault(ch, {})
        node[""] = max(node.get("", (0, w)), (n, w))

    def best(self, word: str, most: int = 0) -> tuple[int, int, str] | None:
        """Cost, negative frequency and form of the cheapest vocabulary word that ``word`` can be read as, within ``most`` edits."""
        # States of the automaton: nodes of the trie with the least cost of coming there.
        def put(to: dict[int, tuple[dict, int]], node: dict, cost: int) -> None:
            if cost <= most and (id(node) not in to or to[id(node)][1] > cost):
                to[id(node)] = (node, cost)

        def added(states: dict[int, tuple[dict, int]]) -> dict[int, tuple[dict, int]]:
            for _ in range(most):
                for node, cost in list(states.values()):
                    for c, at in node.items():
                        if c:
                            put(states, at, cost + 1)
            return states

        states = added({id(self.root): (self.root, 0)})
        for ch in unicodedata.normalize("NFD", word):
            after: dict[int, tuple[dict, int]] = {}
            options = readings(ch)
            for node, cost in states.values():
                for r in options:
                    at: dict | None = node
                    for c in r:
                        at = at.get(c)
                        if at is None:
                            break
                    if at is not None:
                        put(after, at, cost)
                if most and options != ("",):
                    put(after, node, cost + 1)  # left out
                    for c, at in node.items():
                        if c:
                            put(after, at, cost + 1)  # changed
            states = added(after)
            if not states:
                return None
        ends = [(cost, -node[""][0], node[""][1]) for node, cost in states.values() if "" in node]
        return min(ends, default=None)

    def spell(self, word: str, most: int = 0) -> str | None:
        found = self.best(word, most)
        return found and found[2]


def _keyed(words: DataFrame, most: int) -> DataFrame:
    """``word``, ``n`` under every key it must meet others at."""

    def kernel(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            keys = [sorted(shorter(class_form(w), most)) for w in b["word"]]
            yield b.assign(key=keys).explode("key")[["word", "n", "key"]]

    return words.mapInPandas(kernel, "word string, n long, key string")


def spellings(words: DataFrame, vocabulary: DataFrame, most: int = 0) -> DataFrame:
    """``word``, ``spelling``, ``cost`` (0 to most; null where the table decided) of distinct words that aren't plain.

    ``words``: word; ``vocabulary``: word, n, plain words. A word that no vocabulary word explains may still be
    read as the table form of another word that mixes scripts.
    """
    noisy = durable(_keyed(words.select("word").distinct().withColumn("n", F.lit(0).cast("long")), most))
    if most:
        plain = _keyed(vocabulary.select("word", "n"), most)
    else:  # plain words have no other form than their classes
        flat = [(c, r) for c, r in CLASS.items() if c.isascii()]
        plain = vocabulary.select("word", "n", F.translate("word", "".join(c for c, _ in flat), "".join(r for _, r in flat)).alias("key"))
    known = small(noisy.select("key").distinct())
    plain = durable(plain.join(known, "key", "left_semi"))
    buckets = max(BUCKETS, (noisy.count() + plain.count()) // BUCKET_WORDS)
    slot = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("slot")

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        trie, tables, out = Trie(zip(b.column("word").to_pylist(), b.column("n").to_pylist())), Trie(), []
        source = sorted(set(a.column("word").to_pylist()))
        for w in source:
            if mixed(w):
                tables.add(by_table(w), 0)
        for w in source:
            found = trie.best(w, most)
            if found:
                out.append((w, found[2], found[0], -found[1]))
            else:
                out.append((w, by_table(w) if mixed(w) else tables.spell(w) or by_table(w), None, 0))
        return pa.table({"word": pa.array([x[0] for x in out], pa.string()), "spelling": pa.array([x[1] for x in out], pa.string()), "cost": pa.array([x[2] for x in out], pa.int32()), "n": pa.array([x[3] for x in out], pa.int64())})

    left, right = noisy.select("word", slot).groupBy("slot"), plain.select("word", "n", slot).groupBy("slot")
    found = left.cogroup(right).applyInArrow(match, "word string, spelling string, cost int, n long")
    if most:  # a word is in several buckets
        best = F.min_by(F.struct("spelling", "cost"), F.struct(F.coalesce("cost", F.lit(most + 1)), -F.col("n"), "spelling"))
        found = found.groupBy("word").agg(best.alias("b")).select("word", "b.spelling", "b.cost")
    return found.select("word", "spelling", "cost")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _scan(texts: DataFrame) -> DataFrame:
    """One scan of all texts: the plain words of each batch (``word``, ``n``), and of every text that isn't plain ``key``, ``rest``
    (the text with a HOLE for each word that isn't) and ``ws`` (those words in order)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noisy, blank = re.compile(NOISY), re.compile(BLANKS)
        for b in batches:
            every = b.column(0)
            words = pc.value_counts(pc.utf8_split_whitespace(every).flatten())
            word, n = words.field("values"), words.field("counts")
            plain = pc.fill_null(pc.invert(pc.match_substring_regex(word, NOT_PLAIN)), False)
            plain = pc.and_(plain, pc.greater(pc.utf8_length(word), 0))
            word, n = word.filter(plain), n.filter(plain)
            keys, rest, own = [], [], []
            for text in every.filter(pc.match_substring_regex(every, NOT_PLAIN)).to_pylist():
                keys.append(md5(text.encode()).digest())
                found: list[str] = []

                def hole(m: re.Match, found=found) -> str:
                    found.append(m.group())
                    return HOLE

                rest.append(noisy.sub(hole, blank.sub(" ", text.replace("\r\n", "\n"))))
                own.append(found)
            k = len(keys)
            cols = [
                pa.concat_arrays([pa.array(keys, pa.binary()), pa.nulls(len(word), pa.binary())]),
                pa.concat_arrays([pa.array(rest, pa.string()), pa.nulls(len(word), pa.string())]),
                pa.concat_arrays([pa.array(own, pa.list_(pa.string())), pa.nulls(len(word), pa.list_(pa.string()))]),
                pa.concat_arrays([pa.nulls(k, pa.string()), word.cast(pa.string())]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), n.cast(pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "rest", "ws", "word", "n"])

    return texts.select("text").mapInArrow(kernel, "key binary, rest string, ws array<string>, word string, n long")


def _other_forms(texts: DataFrame, most: int) -> DataFrame:
    """``key`` (of the text) and ``form`` of the distinct texts (``text``) that aren't plain."""
    seen = durable(_scan(texts))
    other = seen.where("key IS NOT NULL").select("key", "rest", "ws")
    vocabulary = seen.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = durable(spellings(other.select(F.explode("ws").alias("word")), vocabulary, most))
    # The words of a text come back to it by its key; a text that is there often counts once.
    each = other.select("key", F.posexplode("ws").alias("at", "word")).join(small(chosen), "word")
    whole = other.select("key", "rest", F.lit(None).cast("struct<at:int,spelling:string>").alias("w"))
    parts = whole.unionByName(each.select("key", F.lit(None).cast("string").alias("rest"), F.struct("at", "spelling").alias("w")))
    found = parts.groupBy("key").agg(F.max("rest").alias("rest"), F.array_sort(F.collect_set("w")).alias("ws"))
    own = F.zip_with(F.split("rest", HOLE, -1), "ws", lambda p, w: F.concat(p, F.coalesce(w["spelling"], F.lit(""))))
    return found.select("key", F.array_join(own, "").alias("form"))


def one_form(texts: DataFrame, col: str, most: int = 0) -> DataFrame:
    """``col`` and ``form``: of every distinct text that isn't null its one form, equal where texts look the same.

    The empty text and texts of ignorable characters only have the empty form.
    """
    distinct = texts.select(F.col(col).alias("text")).where("text IS NOT NULL").distinct()
    forms = _other_forms(distinct, most)
    j = distinct.withColumn("key", _key(F.col("text"))).join(forms, "key", "left")
    return j.select(F.col("text").alias(col), F.coalesce("form", "text").alias("form"))


def look_alike_classes(rows: DataFrame, id_col: str, text_col: str, groups: list[str], most: int = 0) -> DataFrame:
    """One row per row of a class of texts that look the same in more than one spelling: ``groups``, ``class_id``, ``variant``
    (which of the spellings), ``id_col``, ``members`` (rows of the class).

    Rows with a null id or text are in no class; a null group is a group; repeated rows count once. Texts that
    all rows of a form share exactly, however many, are no class, since nothing differs.
    """
    t = rows.select(*groups, F.col(id_col), F.col(text_col).alias("text")).dropna(subset=[id_col, "text"])
    forms = durable(_other_forms(t.select("text"), most).select("key", _key(F.col("form")).alias("f_key")))
    m = t.select(*groups, F.col(id_col), _key(F.col("text")).alias("variant"))
    # Only forms that some other text has can be a class of several spellings.
    seen = small(forms.select(F.col("f_key").alias("variant")).distinct().withColumn("f_key", F.col("variant")).unionByName(forms.select(F.col("key").alias("variant"), "f_key")).distinct())
    m = m.join(seen, "variant")
    named = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups]
    m = m.select(*groups, F.col(id_col), "variant", F.md5(F.concat_ws(HOLE, F.hex("f_key"), *named)).alias("class_id")).distinct()
    m = durable(m)
    sizes = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"), F.min("variant").alias("lo"), F.max("variant").alias("hi")).where("lo <> hi")
    return m.join(sizes.select("class_id", "members"), "class_id").select(*groups, "class_id", "variant", id_col, "members")


def look_alike_pairs(rows: DataFrame, id_col: str, text_col: str, groups: list[str]) -> DataFrame:
    """``groups``, ``id_a``, ``id_b`` (id_a < id_b): the classes as pairs of rows whose texts differ in characters.

    A class of n rows has up to n²/4 pairs, so ``look_alike_classes`` is the form for large ones. The members of a
    large class are spread by a salt on one side, which all others meet.
    """
    m = durable(look_alike_classes(rows, id_col, text_col, groups))
    parts = F.ceil(F.col("members") / CLASS_PART).cast("int")
    a = m.select(*groups, "class_id", F.col("variant").alias("v_a"), F.col(id_col).alias("id_a"), F.pmod(F.xxhash64(id_col), parts).cast("int").alias("salt"))
    b = m.select("class_id", F.col("variant").alias("v_b"), F.col(id_col).alias("id_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    return a.join(b, ["class_id", "salt"]).where("id_a < id_b AND v_a <> v_b").select(*groups, "id_a", "id_b").distinct()
