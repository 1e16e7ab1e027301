"""Token counts against the library, with chunks of every kind."""

import random
from functools import reduce

import pytest
from conftest import *  # noqa: F403
from tokenizers import Tokenizer

from skyledger.llm import token_counts as tc

LIB = Tokenizer.from_file(tc.MODEL)
LETTERS = "aeiou tnsrhl'’-.<|>0123éüßñ \ń中İΣ"


def library(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def tokenizer():
    return tc.Tokenizer.load()


@pytest.fixture(scope="module")
def transducer(tokenizer):
    return tc.Transducer(tokenizer)


def odd_texts(n, seed=1):
    r = random.Random(seed)
    for i in range(n):
        s = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 80)))
        yield s + "<|endoftext|>" + s if i % 5 == 0 else s


def test_texts(transducer):
    known = ["", "a", "It's we'll 'st don't 123 4a ''s ---", "<|endoftext|>x<|startoftext|><|endof", "cafe\u0301 \u1112\u1161\u11ab İX ΣΣ", "\x85\xa0\u3000 \x1c", "</w>"]
    for text in [*known, *odd_texts(1500)]:
        assert transducer.count(text) == library(text), text


def test_every_character(transducer):
    """Classes and lower case of all code points, beside letters."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 5000):
        text = "".join(f"a{chr(c)}b " for c in points[k : k + 5000])
        assert transducer.count(text) == library(text), hex(points[k])


def test_states_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(tc, "STATES", 50)
    monkeypatch.setattr(tc, "REMEMBERED", 20)
    t = tc.Transducer(tokenizer)
    for text in odd_texts(200, 2):
        assert t.count(text) == library(text)
        assert len(t.known) <= 20 and len(t.states) < 200


def chunked(t, text, size):
    maps, opened, width = [], False, t.tokenizer.width
    for a, b, within in t.chunks(text, size):
        maps.append(t.transfer(text[max(0, a - width) : a], text[a:b], text[b : b + width], opened, within))
        opened = within
    assert maps
    half = len(maps) // 2
    both = [reduce(tc.composed, x) for x in (maps[:half], maps[half:]) if x]
    return reduce(tc.composed, both), reduce(tc.composed, maps), len(maps)


def test_chunks(transducer):
    """Cuts between words and within long ones; maps composed in two ways."""
    r = random.Random(3)
    parts = ["thetheing", "中文字" * 40, "é" * 90, " ", "the" * 60, "----" * 40, "<|endoftext|>", "x" * 200, "'s", "12", "e\u0301" * 50, "\u0301" * 150]
    for i in range(240):
        alphabet = ["aeioutnsrhl", "-=.,!*#<>|", LETTERS][i % 4] if i % 4 < 3 else None
        text = "".join(r.choice(alphabet) for _ in range(r.randint(100, 900))) if alphabet else "".join(r.choice(parts) for _ in range(r.randint(1, 20)))
        one, two, _ = chunked(transducer, text, 140)
        assert one == two == {tc.FRESH: {tc.FRESH: library(text)}}, text
    *_, n = chunked(transducer, "abc" * 1000, 140)
    assert n > 20


def test_documents(spark, corpus, empty, tokenizer):
    docs, _ = corpus
    r = random.Random(4)
    long = [(600, "".join(r.choice("aeiourst") for _ in range(150_000))), (601, "so it goes on, " * 20_000), (602, "x" * 70_000 + " <|endoftext|> " + "é=" * 50_000), (600, "a " * 2049)]
    docs = docs.unionAll(spark.createDataFrame([(i, t, *[None] * 4) for i, t in long], docs.schema))
    want = sorted((repr(x.doc_id), len((x.text or "").encode()), n := library(x.text), n > 2048) for x in docs.collect())
    for size in (200, tc.CHUNK):
        got = tc.count(docs, tokenizer, chunk=size)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((repr(a), b, c, d) for a, b, c, d in got.collect()) == want
    assert tc.count(empty, tokenizer).count() == 0
    with pytest.raises(ValueError):
        tc.count(docs, tokenizer, chunk=64)
