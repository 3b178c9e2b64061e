import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.llm.encode import BytePairEncoder, default_vocabulary, encode_corpus


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return BytePairEncoder(default_vocabulary()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hard_texts(both):
    own, ref = both
    r = random.Random(3)
    for t in ["", "a" * 5000, " " * 777 + "x", "あ" * 3000, "it's we'll \n\n\t x", "é🙂" * 50, "<|endoftext|>", "".join(chr(r.randint(32, 0x2FFF)) for _ in range(20_000)), "x" * 3 + "​\x00", "A\r\nB  "]:
        assert own.encode(t) == ref.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(both, t):
    own, ref = both
    assert own.encode(t) == ref.encode_ordinary(t)


def test_forgets_beyond_its_bound(both, monkeypatch):
    monkeypatch.setattr("sedimark.llm.encode.KEPT_PIECES", 5)
    own, ref = both
    for t in ["one two three four five six", "seven eight nine", "one two three"]:
        assert own.encode(t) == ref.encode_ordinary(t)


def test_corpus(spark, both):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "Hello world", "x"), (1, "Hello world", "x"), (4, "z" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=lambda x: (x[0] or 0, len(x[1])))
    hello = both[1].encode_ordinary("Hello world")
    assert got == [(None, hello), (1, hello), (1, hello), (2, []), (3, []), (4, both[1].encode_ordinary("z" * 100_000))]
    assert encode_corpus(df.limit(0)).count() == 0
