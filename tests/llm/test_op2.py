import hashlib
import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillfact.llm import op2_bpe as m


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(m.TOKENIZER)


def merge_loop(word, merges):
    """Plain BPE: the earliest merge, leftmost first, again and again."""
    rank = {p: k for k, p in enumerate(merges)}
    w = list(word)
    while True:
        best = min((rank[p], i) for i, p in enumerate(zip(w, w[1:])) if p in rank) if any(p in rank for p in zip(w, w[1:])) else None
        if best is None:
            return w
        i = best[1]
        w[i : i + 2] = [w[i] + w[i + 1]]


def test_automaton_equals_merge_loop():
    rng = random.Random(5)
    for _ in range(60):
        vocab, merges = {"a": 0, "b": 1, "c": 2}, []
        while len(merges) < 9:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        auto = m.Automaton(vocab, merges)
        for n in range(1, 7):
            for w in itertools.product("abc", repeat=n):
                want = merge_loop(w, merges)
                got = ["".join(auto.spelling[i]) for i in auto.encode("".join(w[:-1]), w[-1])]
                assert got == want, (merges, w)
        # deterministic: every sequence of tokens that the arcs accept is the one BPE makes
        for pair in itertools.product(vocab, repeat=2):
            accepted = auto.arc(vocab[pair[0]], vocab[pair[1]])
            assert accepted == (merge_loop("".join(pair), merges) == list(pair)), (merges, pair)


CASES = [
    "", " ", "Hello World", "it's I'LL we've", "a\x1cb \x1f", "É é ﬁ Σίσυφος ΟΔΟΣ", "İstanbul", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>", "日本語 テキスト",
    "1234 ½ ²", "###***%%% !!", "a b c　d", "́x ́", "emoji 😀👍🏽", "th" * 200, "ſt 'ſ", "﻿x", "\x00\x01", "ǅ ﷺ", "\x7f\x80\xad x\u00ady", "_under_score __",
]


def test_equals_library(lib):
    c = m.Codec()
    for t in CASES:
        e = lib.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == e, repr(t)
        assert c.decode(e) == lib.decode(e, skip_special_tokens=False)
    for t in ("x" * 60_000, "ab1" * 9000, "é" * 5000 + " a", "thequickbrownfox" * 40 + "'s"):
        assert c.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t[:20]
    rng = random.Random(2)
    chars = "abcdefghijklmnopqrstuvwxyzéüßñ'.,!#0123 \n\tΣİ日😀́"
    for _ in range(3000):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        assert c.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_code_point_equals_library(lib):
    """Classes, lower case and normal forms are the library's, for every code point by itself and within words."""
    c = m.Codec()
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    sample = lambda p: f"a{p}b {p}{p}9" if ord(p) < 0x20000 else f"a{p}b"
    for k in range(0, len(points), 500):
        text = " ".join(map(sample, points[k : k + 500]))
        if c.encode(text).tolist() != lib.encode(text, add_special_tokens=False).ids:
            raise AssertionError([hex(ord(p)) for p in points[k : k + 500] if c.encode(sample(p)).tolist() != lib.encode(sample(p), add_special_tokens=False).ids])


def test_table_is_read_forward_and_forgotten(lib, monkeypatch):
    c = m.Codec()
    text = "tokenization of unbelievable words"
    want = c.encode(text).tolist()
    places = len(c.automaton.table)
    assert places > 20 and sum(map(len, c.automaton.table)) >= places - 1
    c.known.clear(), c.memory.clear()
    assert c.encode(text).tolist() == want and len(c.automaton.table) == places
    monkeypatch.setattr(m, "PLACES", 5)
    c.known.clear(), c.memory.clear()
    assert c.encode(text).tolist() == want and len(c.automaton.table) < places


def test_query_equals_library(spark, lib):
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = m.op2_bpe_roundtrip(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        e = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_cases(spark, lib):
    df = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, "Hi hi", 2), (2, "Hi hi", 2)], "doc_id long, text string, ids int")
    e = m.encode(df)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in e.collect()) == sorted([(1, []), (0, [])] + [(2, lib.encode("Hi hi", add_special_tokens=False).ids)] * 2)
    assert sorted(r.decoded for r in m.decode(e).collect()) == ["", "", "hi</w> hi</w>", "hi</w> hi</w>"]
    assert m.encode(df.limit(0)).count() == 0 and m.roundtrip_digests(df.limit(0)).count() == 0
