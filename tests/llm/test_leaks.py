import random

import numpy as np

from lodestream.llm import leaks as L

VOCAB = [f"w{k}" for k in range(400)]
ITEMS = "item_id long, language string, passage string"
DOCS = "doc_id long, item_id string, text string"


def passage(seed, n=60):
    rnd = random.Random(seed)
    return [rnd.choice(VOCAB) + f"x{seed}" for _ in range(n)]


P = {k: passage(k) for k in range(8)}


def run(spark, docs, **kw):
    items = spark.createDataFrame([(k, "en", " ".join(p)) for k, p in P.items()] + [(0, "en", " ".join(P[0])), (90, "en", None), (91, "en", ""), (92, "en", "two words")], ITEMS)
    corpus = spark.createDataFrame([(i, "clash", t) for i, t in docs], DOCS)
    return {(r.doc_id, r.item_id) for r in L.find_leaks(corpus, "doc_id", "text", items, "item_id", "passage", **kw).collect()}


def noise(n, seed):
    rnd = random.Random(seed)
    return [f"n{rnd.randrange(5000)}" for _ in range(n)]


def test_lengths_and_changes(spark):
    cut = lambda k, n, at=7: noise(20, k) + P[k][at : at + n] + noise(20, k + 50)
    changed = P[2][:]
    for k in range(9, 60, 11):
        changed[k] = "perhaps"
    added = [x for k, w in enumerate(P[3]) for x in ([w, "indeed"] if k % 12 == 5 else [w])]
    often = [w if k % 3 else "other" for k, w in enumerate(P[4])]
    docs = {
        1: " ".join(cut(0, 12)), 2: " ".join(cut(1, 11)), 3: " ".join(changed), 4: " ".join(added), 5: " ".join(often),
        6: ", ".join(w.upper() for w in cut(5, 30)), 7: "• " + "\n• (3) ".join(cut(6, 25)), 8: None, 9: "", 10: "   ", 11: "few words",
        12: " ".join(noise(30_000, 1) + P[7] + noise(30_000, 2)), 13: " ".join(P[0] + noise(9, 3) + P[1]), 14: " ".join(P[0]), 15: "​".join(" ".join(P[1])),
    }
    want = {(1, 0), (3, 2), (4, 3), (6, 5), (12, 7), (13, 0), (13, 1), (14, 0), (15, 1)}
    got = run(spark, docs.items())
    assert {x for x in got if x[0] != 7} == want


def mixed_docs():
    return [(k, " ".join(noise(5, k) + P[k % 8][3 : 3 + 9 + k % 9] + noise(5, k))) for k in range(40)] + [(99, " ".join(P[0] + P[3] + P[6]))]


def test_salt_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    want = {(k, k % 8) for k in range(40) if 9 + k % 9 >= 12} | {(99, 0), (99, 3), (99, 6)}
    assert run(spark, mixed_docs()) == want
    monkeypatch.setattr(L, "SHARED_PART", 1)
    monkeypatch.setattr(L, "LEAST_BITS", 4)
    monkeypatch.setattr(L, "MOST_BITS", 4)
    assert run(spark, mixed_docs()) == want


def test_items_after_one_pattern(spark):
    # 60 items share a frame of 20 words round 10 of their own: a document of the frame holds them all, of one's own words that one.
    frame = passage(50, 20)
    rows = [(k, "en", " ".join(frame[:10] + passage(100 + k, 10) + frame[10:])) for k in range(60)]
    items = spark.createDataFrame(rows, ITEMS)
    docs = [(1, "x", " ".join(noise(9, 1) + frame[:10] + passage(107, 10)[:5] + noise(9, 2))), (2, "x", " ".join(noise(9, 3) + frame[:9] + noise(9, 4))), (3, "x", " ".join(frame[:10] + passage(103, 10) + frame[10:]))]
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(spark.createDataFrame(docs, DOCS), "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {(1, 7), (3, 3)}


def longest_common_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else 0)
            best = max(best, row[-1])
    return best


def test_runs_on_end_match_brute_force(spark):
    rnd = random.Random(8)
    few = VOCAB[:60]
    items = [(k, [rnd.choice(few) for _ in range(30)]) for k in range(12)]
    docs = []
    for k in range(60):
        own = rnd.choice(items)[1]
        n, at = rnd.randrange(5, 25), rnd.randrange(0, 6)
        docs.append((k, [rnd.choice(few) for _ in range(rnd.randrange(30))] + own[at : at + n] + [rnd.choice(few) for _ in range(rnd.randrange(30))]))
    i = spark.createDataFrame([(k, "en", " ".join(w)) for k, w in items], ITEMS)
    d = spark.createDataFrame([(k, "x", " ".join(w)) for k, w in docs], DOCS)
    got = {(r.doc_id, r.item_id): r.longest for r in L.stretches(d, "doc_id", "text", i, "item_id", "passage", gap=0).collect()}
    for k, w in docs:
        for j, own in items:
            n = longest_common_run(w, own)
            if n >= L.K + L.W - 1:
                assert got[k, j] == n, (k, j)
            else:
                assert got.get((k, j), 0) <= n


def test_many_items_in_one_pass(spark):
    items = spark.range(20_000).selectExpr("id AS item_id", "'en' AS language", "array_join(transform(sequence(0, 14), x -> concat('i', id % 9000, 'w', x)), ' ') AS passage")
    docs = spark.range(300).selectExpr("id AS doc_id", "'x' AS item_id", "concat('before it ', array_join(transform(sequence(0, 12), x -> concat('i', id * 31, 'w', x)), ' '), ' after it') AS text")
    found = L.find_leaks(docs, "doc_id", "text", items, "item_id", "passage")
    scans = found._jdf.queryExecution().toString().count("MapInArrow")
    assert scans <= 4 * 2 and found.count() == sum(len([i for i in (k * 31 % 9000, k * 31 % 9000 + 9000, k * 31 % 9000 + 18000) if i < 20_000]) for k in range(300) if k * 31 < 9000)


def test_scripts_without_spaces(spark):
    text = "空气质量监测站每天公布各城市的读数并由专家核对之后存档"
    items = spark.createDataFrame([(1, "zh", text), (2, "zh", "完全不同的另外一段文字没有任何相同的内容在里面")], ITEMS)
    d = spark.createDataFrame([(1, "x", "开头。" + text[3:18] + "结尾"), (2, "x", text[3:13] + "等等"), (3, "x", "mixed " + text + " text")], DOCS)
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(d, "doc_id", "text", items, "item_id", "passage").collect()} == {(1, 1), (3, 1)}


def test_every_shared_run_of_six_words_has_a_common_fingerprint():
    rnd = random.Random(4)
    for _ in range(200):
        span = [rnd.choice(VOCAB[:30]) for _ in range(L.K + L.W - 1)]
        texts = [noise(rnd.randrange(9), rnd.random()) + span + noise(rnd.randrange(9), rnd.random()) for _ in range(2)]
        prints = []
        for t in texts:
            codes = L.word_codes(t)
            at = L.fingerprints(codes, np.zeros(len(t), int))
            prints.append(set(L.gram_codes(codes)[at].tolist()))
        assert prints[0] & prints[1]


def test_empty_tables(spark):
    assert run(spark, []) == set()
    empty = spark.createDataFrame([], ITEMS)
    corpus = spark.createDataFrame([(1, "x", "some text of a few words here")], DOCS)
    assert L.find_leaks(corpus, "doc_id", "text", empty, "item_id", "passage").count() == 0


def test_short_leaks_with_a_change_near_an_end(spark):
    docs, want = {}, set()
    for n in range(13, 17):
        for at in (3, n - 4):
            part = P[n % 8][9 : 9 + n]
            part[at] = "perhaps"
            docs[n * 100 + at] = " ".join(noise(15, n) + part + noise(15, at))
            want.add((n * 100 + at, n % 8))
    part = P[5][4:16]
    part[3] = "perhaps"
    docs[1] = " ".join(noise(15, 1) + part + noise(15, 2))  # eleven words alike
    part = P[6][2:28]
    for at in (8, 13, 17):
        part[at] = "perhaps"
    docs[2] = " ".join(noise(15, 3) + part + noise(15, 4))  # runs of 8, 4, 3 and 8
    assert run(spark, docs.items()) == want | {(2, 6)}


def test_runs_between_changes_need_no_fingerprint():
    doc = P[1][:9] + ["x"] + P[1][10:12] + ["y"] + P[1][13:30]
    codes = L.word_codes(doc + P[1]).tolist()
    doc, own = codes[: len(doc)], codes[len(doc) :]
    assert L.stretch(doc, [False] * len(doc), own, [False] * len(own), [(0, 0), (13, 13)], 3)[:3] == (28, 2, 17)


def test_repeated_documents_and_items(spark):
    docs = [(1, " ".join(P[0])), (1, " ".join(P[0])), (1, " ".join(P[1])), (None, " ".join(P[2]))]
    assert run(spark, docs) == {(1, 0), (1, 1), (None, 2)}
