import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import encoding

PATH = os.path.join(encoding.TOKENIZERS, encoding.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library(reference, text):
    assert encoding.encoder(PATH).encode(text) == reference(text)


def test_long_pre_tokens(reference):
    for t in ("a" * 30_000, "אבגד" * 5000, "ab" * 20_000, "<|endoftext|> it's"):
        assert encoding.encoder(PATH).encode(t) == reference(t)


def test_queue():
    q = encoding.RankQueue()
    for r, at in ((50_000, 1), (3, 2), (4100, 3), (3, 4), (64, 5)):
        q.push(r, at)
    out = []
    while q.top:
        out.append(q.pop())
    assert out == [(3, [2, 4]), (64, [5]), (4100, [3]), (50_000, [1])]


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello שלום", 9), (2, None, 9), (3, "", 9), (None, " ", 9), (1, "Hello שלום", 9)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encoding.encode(df).collect()]
    assert (2, []) in got and (3, []) in got and len(got) == 5 and got[0] == got[4] and len(got[3][1]) == 1
    assert encoding.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encoding.token_counts(df).collect()}[3] == 0


def test_ids_stand_for_the_text(spark):
    texts = ["", None, "שלום world  \n\n<|endoftext|> é́ 🙂", "a" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in encoding.decode(encoding.encode(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
