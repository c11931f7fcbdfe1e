import itertools
import random

import pytest

from lodestream.llm import canonical as C

NAMES = [(1, "Khidhinagar"), (1, "खिधिनगर"), (1, "Tokhehabad"), (2, "Khajipatti"), (3, "Bara Khajipatti"), (4, "Medipur"), (5, "Dhejasar"), (6, "Dhejisar"), (7, "Bengaluru"), (8, "New Delhi Cantonment East"), (9, "Thiruvananthapuram"), (10, "Delhi"), (11, "Navi Mumbai")]
# What people write round names; its words are common among the values.
ROUND = ["{} City", "City of {}", "{} (M Corp)", "Nagar Nigam {}", "{} Dist.", "{}, Sonadesh", "{} office", "1. {}", "{}"]


@pytest.fixture(scope="module")
def found(spark):
    values = [f.format(n) for f in ROUND for _, n in NAMES]
    values += [v for v, _ in CASES]
    df = spark.createDataFrame([(k, v, 5) for k, v in enumerate(values)], "row_id long, city string, entry int")
    ref = spark.createDataFrame([(e, n, "") for e, n in NAMES], "id int, name string, other string")
    got = C.map_values(df, "row_id", "city", ref, "id", ["name", "other"]).collect()
    return {values[r.row_id]: (r.entry, r.how) for r in got}


CASES = [
    ("KHIDHINAGAR", 1), ("* Khidhinagar", 1), ("Khidhinagar, Sonadesh", 1), ("City of Tokhehabad #", 1), ("खिधिनगर", 1), ("Khi-dhinagar", 1), ("Khidhinagr", 1), ("Khidhingaar", 1), ("Kheedhinagar", 1),
    ("Bara Khajipatti (M Corp)", 3), ("Baa Khajipatti", 3), ("bara-khajipatti", 3), ("Khajipatti Bara", 3), ("1. Khajipatti", 2), ("Medipoor", 4), ("Medipore Dist.", 4), ("Dhejsar", 0), ("Dhejasar", 5),
    ("Sonadesh", 0), ("n/a", 0), ("", 0), ("   ", 0), ("Station 7", 0), ("Westerholt Junction", 0), ("x" * 50_000, 0), ("x " * 3_000, 0),
    ("software Bengaluru office", 7), ("Delhi East New Cantonment", 8), ("Thiruvanthapurm", 9), ("Nagar Nigam Thiruvanantapuram", 9), ("Navimumbai", 11), ("Khidhinagarville", 0), ("Medipur Khidhinagar", 1),
]


@pytest.mark.parametrize(("typed", "entry"), CASES)
def test_values(found, typed, entry):
    assert found[typed][0] == entry, found[typed]


def test_all_ways_of_writing_round_a_name(found):
    for f in ROUND:
        for e, n in NAMES:
            assert found[f.format(n)][0] == e


def gazetteer(names):
    return C.Gazetteer([(e, C.fold(n), [1.0] * len(C.fold(n).split())) for e, n in names])


def test_mentions_are_the_longest_that_do_not_overlap():
    g = gazetteer([(1, "port blair"), (2, "blair town hall"), (3, "hall"), (4, "blair")])
    assert [x[2] for x in g.mentions("old port blair town hall")] == ["blair town hall"]
    assert [x[2] for x in g.mentions("port blair and the hall")] == ["port blair", "hall"]
    assert g.mentions("portblair") == [] and gazetteer([]).mentions("x") == []


def brute(words, weights, names, least):
    """Similarity over all names and all alignments, without an index."""
    out = {}
    variants = [(words, weights)] + [([*words[:k], words[k] + words[k + 1], *words[k + 2 :]], [*weights[:k], max(weights[k : k + 2]), *weights[k + 2 :]]) for k in range(len(words) - 1)]
    for name in names:
        for ws, vs in variants:
            for parts in ([name.split()] if " " not in name else [name.split(), [name.replace(" ", "")]]):
                each = len(name.split()) / len(parts)
                for order in itertools.permutations([*range(len(ws)), *[None] * len(parts)], len(parts)):
                    got, gone = 0.0, 0.0
                    for p, i in zip(parts, order):
                        if i is not None:
                            n = C.edits(ws[i], p, max(C.tolerance(ws[i]), C.tolerance(p)))
                            if n > max(C.tolerance(ws[i]), C.tolerance(p)):
                                break
                            got += each * (1 - C.COST * n / len(p))
                            gone += vs[i]
                    else:
                        s = got / (len(name.split()) + sum(vs) - gone)
                        if got and s >= least:
                            out[name] = max(out.get(name, 0), s)
    return out


def test_similarity_matches_brute_force():
    rnd = random.Random(2)
    base = ["khidhinagar", "bara khajipatti", "medipur", "dhejasar", "dhejisar", "navi mumbai", "lone", "old port harbour"]
    g = gazetteer(list(enumerate(base)))
    for _ in range(200):
        words = rnd.choice(base).split() + rnd.choice([[], ["city"], ["x"]])
        rnd.shuffle(words)
        for _ in range(rnd.choice([0, 1, 2])):
            i = rnd.randrange(len(words))
            w = list(words[i])
            k = rnd.randrange(len(w))
            w[k : k + rnd.choice([0, 1])] = rnd.choice("abdxz")
            words[i] = "".join(w)
        weights = [rnd.choice([0.5, 1.0, 2.0]) for _ in words]
        got, want = g.scored(words, weights, 0.3), brute(words, weights, base, 0.3)
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}, words


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Khidhinagr"), (2, None), (3, "Khidhinagr"), (3, "Khidhinagr"), (None, "Medipur"), (4, "?")], "row_id long, city string")
    ref = spark.createDataFrame([(1, "Khidhinagar"), (1, "Khidhinagar"), (4, "Medipur"), (None, "Lone"), (5, None), (6, " ")], "id long, name string")
    got = sorted(((r.row_id or 0, r.entry, r.how) for r in C.map_values(df, "row_id", "city", ref, "id", ["name"], 0.3).collect()))
    assert got == [(0, 4, "exact"), (1, 1, "similar"), (3, 1, "similar"), (3, 1, "similar"), (4, 0, "none")]
    assert {r.entry for r in C.map_values(df, "row_id", "city", ref.where("id > 9"), "id", ["name"]).collect()} == {0}
    assert C.map_values(df.where("row_id > 9"), "row_id", "city", ref, "id", ["name"]).count() == 0


def test_blocks_of_the_list_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(CASES)], "row_id long, city string")
    ref = spark.createDataFrame(NAMES, "id long, name string")
    whole = sorted(map(tuple, C.map_values(df, "row_id", "city", ref, "id", ["name"]).collect()))
    monkeypatch.setattr(C, "BLOCK", 3)
    assert sorted(map(tuple, C.map_values(df, "row_id", "city", ref, "id", ["name"]).collect())) == whole


def test_spellings_held_out(spark):
    """Recall and precision over spellings made from a random list: errors within the tolerance, and names of no entry."""
    rnd = random.Random(11)
    syl = ["kha", "ji", "bo", "ne", "lu", "sho", "ri", "ta", "ve", "mu", "dhi", "go"]
    make = lambda: ("".join(rnd.choice(syl) for _ in range(rnd.randrange(3, 5))) + rnd.choice(["pur", "nagar", "ganj"])).capitalize()
    names = sorted({make() for _ in range(150)})
    listed, unlisted = names[::2], names[1::2]
    rows = []
    for k, n in enumerate(listed):
        for _ in range(4):
            w = list(n)
            i = rnd.randrange(len(w))
            w[i : i + rnd.choice([0, 1])] = rnd.choice("abdeikmopstu")
            rows.append((len(rows), rnd.choice(ROUND).format("".join(w)), k + 1))
    rows += [(len(rows) + i, rnd.choice(ROUND).format(n), 0) for i, n in enumerate(unlisted)]
    df = spark.createDataFrame(rows, "row_id long, city string, truth long")
    ref = spark.createDataFrame(list(enumerate(listed, 1)), "id long, name string")
    got = {r.row_id: r.entry for r in C.map_values(df, "row_id", "city", ref, "id", ["name"]).collect()}
    meant = [(got[k], t) for k, _, t in rows]
    recall = sum(g == t for g, t in meant if t) / sum(t > 0 for _, t in meant)
    precision = sum(g == t for g, t in meant if g) / sum(g > 0 for g, _ in meant)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.95 and precision > 0.95
