import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.VOCABULARY, "rb"))}
    return K.codec(K.VOCABULARY), tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text("ab ", max_size=200), st.text("aeinorst", max_size=80), st.text("  \n\t.,'सक्षि0123", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_reference_encoder(both, text):
    mine, other = both
    text = text.encode("utf-8", "ignore").decode()
    assert mine.encode(text) == other.encode_ordinary(text)
    assert mine.decode(mine.encode(text)) == text


def test_long_pieces_and_special_strings(both):
    mine, other = both
    rnd = random.Random(1)
    for text in ("a" * 100_000, "ab" * 20_000, " " * 5_000, "<|endoftext|> and <|startoftext|>", "".join(rnd.choice("etaoinshrdlu") for _ in range(50_000))):
        assert mine.encode(text) == other.encode_ordinary(text)
    assert len(mine.known) and all(len(p) <= K.CACHE_BYTES for p in mine.known)


def test_operator(spark, both):
    text = "Air quality fell. वायु " * 3000
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "y"), (3, None, "z"), (4, text, None), (1, "a b", "x")], "doc_id long, text string, ids string")
    out = K.encode(df, "doc_id", "text")
    assert out.columns == ["doc_id", "ids"] and out.schema["ids"].dataType.simpleString() == "array<int>"
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert got[2] == [[]] and got[3] == [[]] and len(got[1]) == 2 and got[4][0] == both[1].encode_ordinary(text)
    back = {r.doc_id: r.text for r in K.decode(out, "doc_id", "ids").collect()}
    assert back == {1: "a b", 2: "", 3: "", 4: text}
    assert K.encode(df.where("doc_id > 9"), "doc_id", "text").count() == 0


def test_vocabulary_is_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MAX_BYTES", 10)
    with pytest.raises(ValueError):
        K.read_ranks(K.VOCABULARY)
