import pytest

from lodestream.llm import lookalike as L

SAME = [
    ("file of grade", "ﬁle оf grаde"), ("This is 25", "Ｔｈｉｓ ｉｓ ２５"), ("résumé", "résumé"), ("within days", "with​in days­"),
    ("Stage III", "Stage Ⅲ"), ("µg", "μg"), ("last-mile", "last‐mile"), ("ज़मीन", "ज़मीन"), ("फ़", "फ़"), ("Oslo", "Οslο"),
]
DIFFERENT = [("m3", "m³"), ("cafe", "café"), ("The", "the"), ("a-b", "a—b"), ("Il", "ll"), ("0", "O"), ("68 percent", "68 per cent"), ("a.", "a"), ("2", "२"), ("rn", "m"), ("½", "1/2")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_table_makes_same_look_same(a, b):
    assert L.by_table(a) == L.by_table(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_table_keeps_what_is_seen(a, b):
    assert L.by_table(a) != L.by_table(b)


def test_trie_is_a_weighted_edit_automaton():
    t = L.Trie([("list", 9), ("Iist", 1), ("file", 5), ("résumé", 3)])
    assert t.spell("ӏist") == "list" and t.spell("ﬁle") == "file" and t.spell("ré​sumé") == "résumé"
    assert t.spell("fi1e") is None and t.spell("fi1e", 1) == "file" and t.spell("fle", 1) == "file" and t.spell("filee", 1) == "file"
    assert t.spell("") is None and L.Trie([]).spell("x") is None


def test_trie_matches_brute_force():
    import random

    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(2, 6))) for _ in range(40)}
    t = L.Trie([(w, 1) for w in words])
    for _ in range(300):
        x = "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 6)))
        # insertions, deletions and changes, without swaps
        near = [w for w in words if lev(x, w) <= 1]
        assert (t.spell(x, 1) is None) == (not near)
        if near:
            assert lev(x, t.spell(x, 1)) == min(lev(x, w) for w in near)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def looks(a, b):
    """Whether two texts look the same, character by character, under any of the readings; by brute force."""
    import itertools
    import unicodedata

    def all_forms(x):
        each = [L.readings(c) for c in unicodedata.normalize("NFD", x.replace("\r\n", "\n"))]
        return {unicodedata.normalize("NFC", "".join(p)) for p in itertools.product(*each)}

    return bool(all_forms(a) & all_forms(b))


def test_pairs(spark):
    texts = ["Stage III measures", "Stage Ⅲ measures", "Stage III measures", "Stage ӏII measures", "stage III measures", "", "​", None, "résumé", "résumé", "a Сο", "a Co", "a\xa0Co", "tab\tb", "tab b"]
    df = spark.createDataFrame([(t, f"{k:02d}", x, "x") for t in ("p", "q") for k, x in enumerate(texts)] + [("p", None, "Stage Ⅲ measures", "x")], "tbl string, id string, text string, form string")
    got = {(r.tbl, r.id_a, r.id_b) for r in L.look_alike_pairs(df, "id", "text", ["tbl"]).collect()}
    keep = [(k, x) for k, x in enumerate(texts) if x is not None]
    want = {(t, f"{a:02d}", f"{b:02d}") for t in "pq" for a, x in keep for b, y in keep if a < b and x != y and looks(x, y)}
    assert got == want
    assert L.look_alike_pairs(df.where("id = 'none'"), "id", "text", ["tbl"]).count() == 0


def test_very_long_texts_and_words(spark):
    long = ["long " * 20_000 + "а", "long " * 20_000 + "a", "x" * 200_000 + "а", "x" * 200_000 + "a"]
    df = spark.createDataFrame(list(enumerate(long)), "id long, text string")
    assert {(r.id_a, r.id_b) for r in L.look_alike_pairs(df, "id", "text", []).collect()} == {(0, 1), (2, 3)}


def test_the_vocabulary_decides_what_the_table_leaves(spark, monkeypatch):
    # Letters that aren't in the table, and words wholly in another script: read as words only where the vocabulary has them.
    rows = [(0, "the payment"), (1, "the pαуmεnt"), (2, "the pαyment"), (3, "СО in air"), (4, "CO in air"), (5, "ΝΟ"), (6, "для"), (7, "Ꮯlean aır"), (8, "Clean air")]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = lambda: {(r.id_a, r.id_b) for r in L.look_alike_pairs(df, "id", "text", []).collect()}
    assert pairs() == {(0, 2), (3, 4), (7, 8)}
    forms = {r.text: r.form for r in L.one_form(df, "text").collect()}
    assert forms["ΝΟ"] == "ΝΟ" and forms["для"] == "для" and forms["the pαyment"] == "the payment"
    whole = L.spellings
    monkeypatch.setattr(L, "spellings", lambda w, v, most=0: whole(w, v.where("false"), most))
    assert pairs() == set()


@pytest.mark.parametrize("most", [0, 1])
def test_spellings_match_brute_force(spark, most):
    import random

    rnd = random.Random(5 + most)
    like = {"a": "aаα", "b": "bЬ", "I": "IІӏ", "l": "lӏ", "e": "eе​", "d": "ddｄ"}
    plain = sorted({"".join(rnd.choice("abIled") for _ in range(rnd.randrange(1, 6))) for _ in range(60)})
    noisy = sorted({"".join(rnd.choice(like[c]) for c in rnd.choice(plain)) + rnd.choice(["", "", "x", "​", "é"]) for _ in range(120)} - set(plain))
    noisy = [w for w in noisy if not w.isascii()]
    vocab = spark.createDataFrame([(w, k + 1) for k, w in enumerate(plain)], "word string, n long")
    got = {r.word: (r.spelling, r.cost) for r in L.spellings(spark.createDataFrame([(w,) for w in noisy], "word string"), vocab, most).collect()}
    trie = L.Trie([(w, k + 1) for k, w in enumerate(plain)])  # one trie of all words, no buckets
    assert set(got) == set(noisy)
    for w in noisy:
        best = trie.best(w, most)
        if best:
            assert got[w] == (best[2], best[0]), w
        else:
            assert got[w][1] is None, w


def test_classes_of_copies(spark):
    # A hot text in two spellings is one class, its exact copies no pairs; a group of copies alone is no class.
    rows = [(k, "one text" if k % 2 else "οne text") for k in range(40)] + [(100 + k, "other") for k in range(50)] + [(200, None)] + [(0, "οne text")]
    df = spark.createDataFrame(rows, "id long, text string")
    c = L.look_alike_classes(df, "id", "text", []).collect()
    assert {r.id for r in c} == set(range(40)) and {r.members for r in c} == {40} and len({r.class_id for r in c}) == 1 and len({bytes(r.variant) for r in c}) == 2
    assert L.look_alike_pairs(df, "id", "text", []).count() == 400


def test_salted_classes_give_the_same_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(k, "one text" if k % 3 else "οne text") for k in range(60)], "id long, text string")
    whole = L.look_alike_pairs(df, "id", "text", []).count()
    monkeypatch.setattr(L, "CLASS_PART", 7)
    assert L.look_alike_pairs(df, "id", "text", []).count() == whole == 800


def test_one_form(spark):
    df = spark.createDataFrame([("plain",), ("plaіn",), (None,), ("plaіn",)], "t string")
    assert {(r.t, r.form) for r in L.one_form(df, "t").collect()} == {("plain", "plain"), ("plaіn", "plain")}
