import random

import numpy as np
import pytest

from lodestream.llm import subjects as S

PHRASES = {
    "law": (["appellate bench", "penalty schedule", "consent order", "show cause notice"], ["breach of terms", "unlicensed operators", "levy of compensation"]),
    "health": (["chest clinic", "asthma ward", "health worker", "cardiac unit"], ["night time coughing", "oxygen readings", "chronic bronchitis"]),
    "transport": (["bus depot", "parking cell", "traffic marshal", "metro service"], ["old diesel vans", "kerbside parking", "tailpipe testing"]),
}
FRAMES = ["Residents asked why the {a} looks after {o} in {n} wards.", "Compared with May, {o} rose by {n} per cent said the {a}.", "The {a} and the {b} disagree on {o}."]
NEUTRAL = ["The meeting closed at 7:30 with thanks to all present.", "Talks stalled like a bus in July traffic, one member said.", "The chair joked that the agenda needed a doctor, not a secretary.", "Details are given in annex 7 and are not repeated here."]
LISTING = "Daily listing\nVery Poor\nCO, NO2\n1/9 2\nModerate"
rnd = random.Random(11)


def sentence(subject):
    agents, objects = PHRASES[subject]
    return rnd.choice(FRAMES).format(a=rnd.choice(agents), b=rnd.choice(agents), o=rnd.choice(objects), n=rnd.randrange(2, 90))


def corpus():
    docs, truth, labels = [], {}, []
    for i in range(500):
        own = rnd.sample(sorted(PHRASES), rnd.choice([1, 1, 2]))
        lines = [sentence(s) for s in own for _ in range(rnd.randrange(4, 7))] + rnd.choices(NEUTRAL, k=3)
        if len(own) == 1:
            lines.append(sentence(rnd.choice(sorted(PHRASES))))  # a passing mention
        rnd.shuffle(lines)
        docs.append((i, rnd.choice([" ", "\n", "\n• "]).join(lines), "x"))
        truth[i] = set(own)
        if i % 6 == 0:
            labels += [(i, s, "a1") for s in (own if rnd.random() > 0.05 else ["law"])]
    docs += [(1000, LISTING, "x"), (1001, " ".join(NEUTRAL), "x"), (1002, None, "x"), (1003, "", "x"), (1004, "   ", None), (1005, (sentence("law") + " ") * 3000, "x")]
    truth |= {1005: {"law"}}
    return docs, truth, [*labels, *labels[:5], (None, "law", "a"), (77777, "law", "a"), (3, "unknown", "a"), (3, None, "a")]


@pytest.fixture(scope="module")
def found(spark):
    docs, truth, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(s, "x") for s in PHRASES] + [("law", "twice"), (None, "x")], "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    got = {}
    for r in S.subject_areas(d, "doc_id", "text", areas, lab).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return d, areas, lab, got, truth


def test_held_out_documents(found):
    _, _, lab, got, truth = found
    labelled = {r.doc_id for r in lab.collect()}
    unseen = [i for i in truth if i not in labelled]
    right = sum(got.get(i, set()) == truth[i] for i in unseen)
    assert len(unseen) > 300 and right / len(unseen) >= 0.97


def test_documents_without_subject(found):
    got = found[3]
    assert not any(i in got for i in (1000, 1001, 1002, 1003, 1004)) and got[1005] == {"law"}


def test_empty_inputs(found):
    d, areas, lab, _, _ = found
    assert S.subject_areas(d, "doc_id", "text", areas, lab.where("doc_id < 0")).count() == 0
    assert S.subject_areas(d, "doc_id", "text", areas.where("subject = '-'"), lab).count() == 0
    assert S.subject_areas(d.where("doc_id < 0"), "doc_id", "text", areas, lab).count() == 0


def test_a_smaller_sample_still_finds_most(found):
    d, areas, lab, _, truth = found
    small = S.Model(sample=30)
    got = {}
    for r in S.subject_areas(d, "doc_id", "text", areas, lab, small).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i, set()) == truth[i] for i in truth) / len(truth) > 0.8


def test_repeated_rows_and_clashing_names(found):
    d, areas, lab, got, _ = found
    twice = d.where("doc_id < 20")
    r = S.subject_areas(d.unionByName(twice), "doc_id", "text", areas, lab).collect()
    assert len(r) == len({(x.doc_id, x.subject) for x in r})


def cells(seed, docs=30, terms=25, subjects=3):
    g = np.random.default_rng(seed)
    x = g.poisson(1, (docs, terms))
    doc, term = np.nonzero(x)
    labels = [sorted(g.choice(subjects, g.integers(1, 3), replace=False).tolist()) for _ in range(docs)]
    return doc, term, x[doc, term].astype(float), labels


def test_updates_never_raise_the_divergence():
    for seed in range(5):
        doc, term, n, labels = cells(seed)
        *_, divergence = S.factor(doc, term, n, labels, 3, S.Model(rounds=30, spread=0.0))
        assert len(divergence) == 30 and all(b <= a + 1e-6 for a, b in zip(divergence, divergence[1:])) and divergence[-1] < divergence[0]


def test_factors_match_dense_updates():
    doc, term, n, labels = cells(7)
    m = S.Model(rounds=5, spread=0.0)
    code, comp, h, _, _ = S.factor(doc, term, n, labels, 3, m)
    x = np.zeros((30, 25))
    x[doc, term] = n
    mask = np.zeros((30, 4), bool)
    mask[:, 3] = True
    for i, own in enumerate(labels):
        mask[i, own] = True
    dense = seeds(x, labels)
    w = mask * (x.sum(1) / mask.sum(1))[:, None]
    for _ in range(5):
        w = w * ((x / np.maximum(w @ dense, 1e-300)) @ dense.T)
        dense = dense * (w.T @ (x / np.maximum(w @ dense, 1e-300))) / np.maximum(w.sum(0), 1e-12)[:, None]
        scale = dense.sum(1)
        dense, w = dense / np.maximum(scale, 1e-12)[:, None], w * scale
    got = np.zeros((4, 25))
    got[comp, code] = h
    assert np.allclose(got, dense, atol=1e-9)


def seeds(x, labels):
    """The profiles that the updates start from, by dense matrices."""
    size = np.array([sum(k in own for own in labels) for k in range(3)], float)
    rate = np.zeros((4, x.shape[1]))
    for i, own in enumerate(labels):
        for k in own:
            rate[k] += (x[i] > 0) / len(own) / size[k]
    prefer = rate / np.maximum(rate.sum(0), 1e-12)
    out = x.sum(0) * prefer**2
    out[3] = 0.3 * x.sum(0)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def test_folding_in_matches_dense_updates():
    table = S.fit([" ".join(sentence(s) for _ in range(5)) for s in sorted(PHRASES) * 8], [[k] for k in range(3)] * 8, 3, S.Model())
    f = S.Folder(table, 3, S.Model())
    text = sentence("law") + " " + sentence("health") + " nothing known here"
    s, of, long, comp, w = f.weights([text, None, ""])
    rows = table.to_pylist()
    for no, part in enumerate([x for x in text.replace("May,", "May").split(". ")][:2]):
        words = ["#" if x.isdigit() else x for x in part.lower().replace(".", "").replace(",", "").split()]
        own = [{r["subject"]: r["profile"] for r in rows if r["word"] == a and r["next"] == b} for a, b in [*((x, None) for x in words), *zip(words, words[1:])]]
        own = [o for o in own if o]
        weights = {k: 1.0 for o in own for k in o}
        for _ in range(S.Model().folds):
            after = dict.fromkeys(weights, 0.0)
            for o in own:
                total = sum(weights[k] * h for k, h in o.items())
                for k, h in o.items():
                    after[k] += weights[k] * h / total
            weights = after
        got = {None if c == 3 else int(c): float(v) for at, c, v in zip(s, comp, w) if at == no}
        assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-9 for k in got), part


def test_many_subjects():
    n = 1500
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    texts = [f"al{name(k)} be{name(k)} ga{name(k)} de{name(k)} every where" for k in range(n) for _ in range(2)]
    f = S.Folder(S.fit(texts, [[k] for k in range(n) for _ in range(2)], n, S.Model()), n, S.Model())
    text, k, count = f.tally([None, f"the al{name(1234)} be{name(1234)} ga{name(1234)} de{name(1234)} was seen"])
    assert (text.tolist(), k.tolist(), count.tolist()) == ([1], [1234], [1])
