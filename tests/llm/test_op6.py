import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillfact.llm import op6_packing as m


def round_robin(sizes, shares):
    """Plain deficit round-robin: what each window takes from each queue, deficits carried from window to window."""
    left, deficit, shares = np.array(sizes, np.int64), np.zeros(len(sizes)), np.array(shares, float)
    out = []
    while left.sum():
        room, got = int(min(m.WINDOW, left.sum())), np.zeros(len(left), np.int64)
        while room:
            live = left > 0
            deficit = np.where(live, deficit, 0.0)
            deficit += room * shares * live / (shares * live).sum()
            take = np.minimum(np.maximum(np.floor(deficit).astype(np.int64), 0), left)
            while take.sum() < room and (left > take).any() and take.sum() < room - (left == take).sum() * room:
                k = int(np.argmax(np.where(left > take, deficit - take, -np.inf)))
                take[k] += 1
            while take.sum() > room:
                k = int(np.argmin(np.where(take > 0, deficit - take, np.inf)))
                take[k] -= 1
            if not take.sum():
                take[int(np.argmax(np.where(live, deficit, -np.inf)))] = 1
            deficit, left, got, room = deficit - take, left - take, got + take, room - int(take.sum())
        out.append(got)
    return np.array(out).reshape(len(out), len(left))


def check_packing(pieces, docs, alpha=m.ALPHA):
    """pieces: rows; docs: list of (doc_id, ids, source)."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for d, ids, _ in docs:
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    total = sum(len(x) for _, x, _ in docs)
    padded = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0
    size = defaultdict(int)
    for _, ids, s in docs:
        size[s] += len(ids)
    # window by window what a plain round-robin with carried deficits takes from each source
    names = list(size)
    want = round_robin([size[x] for x in names], [size[x] ** alpha for x in names]).cumsum(0)
    got = np.zeros((total // 2048, len(names)), np.int64)
    for p in pieces:
        if p.sequence_id < len(got):
            got[p.sequence_id, names.index(p.source)] += p.length
    assert np.abs(got.cumsum(0) - want[: len(got)]).max(initial=0) <= 3


def test_tokenizer_equals_library():
    t, lib = m.Tokenizer(), Tokenizer.from_file(m.TOKENIZER)
    cases = ["", "a", " a", "a  b", "a \n b", "a\n b\n\n c", "x ", "it's we'll", "é ü  z", "a\tb c", "<|endoftext|> x", "x<|endoftext|>", "12 3,4 ###", "日本 語", "  x", "a \x1cb", "\n\n", "I've  I'm\r\n ok"]
    for c in cases:
        assert np.frombuffer(t(c), "<u2").tolist() == lib.encode(c, add_special_tokens=False).ids, repr(c)
    assert t.fast is not None
    rng = __import__("random").Random(1)
    chars = [chr(c) for c in range(1, 0x250)] + list("abcdef   \n\t'sdmtllverR.,!") * 20
    for _ in range(4000):
        c = "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(t(c), "<u2").tolist() == lib.encode(c, add_special_tokens=False).ids, repr(c)
    long = "ab" * 3000 + " " * 500 + "#" * 999
    assert np.frombuffer(t(long), "<u2").tolist() == lib.encode(long, add_special_tokens=False).ids


def test_schedule_carries_deficits():
    s = m.Schedule([5000, 333, 70000, 1, 12345])
    w = np.arange(s.windows + 1)
    c = s.served(w)
    assert (np.diff(c, axis=0) >= 0).all() and c[-1].tolist() == [5000, 333, 70000, 1, 12345]
    assert (c.sum(1) == np.minimum(w * 2048, s.total)).all()
    due = np.minimum(w * 2048, s.total)[:, None] * s.p
    assert np.abs(due - c).max() < 3
    for k in w:  # a window's result doesn't depend on the windows asked for with it
        assert (s.served(w[k : k + 1]) == c[k : k + 1]).all()
    for q in range(5):
        at = np.arange(0, int(s.n[q]), 97)
        win = s.window_of(np.full(len(at), q), at)
        assert ((c[win, q] <= at) & (at < c[win + 1, q])).all()


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_plain_round_robin(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 200_000, 7)
    shares = rng.random(7) + 0.05 if seed % 2 else sizes**0.5
    s = m.Schedule(sizes, shares)
    c = s.served(np.arange(1, s.windows + 1))
    # a queue that ends may leave the plain one's other queues with a fraction of a token each
    assert np.abs(c - round_robin(sizes, shares).cumsum(0)).max() <= 3


def test_queues_without_a_share():
    with pytest.raises(ValueError):
        m.Schedule([4096, 4096], [1, 0])
    mix = m.Mixture([4096, 4096], [1])  # the second has none
    got = [[int(mix.at(np.array([w]), np.array([q]))[0][0]) for q in (0, 1)] for w in range(5)]
    assert got == [[0, 0], [2048, 0], [4096, 0], [4096, 2048], [4096, 4096]]


def test_target_shares():
    s = m.Schedule([40960, 40960], [3, 1])
    c = s.served(np.arange(s.windows + 1))
    assert np.abs(np.diff(c, axis=0)[:20, 0] - 1536).max() <= 1
    assert c[-1].tolist() == [40960, 40960]


@pytest.mark.parametrize("parts", [1, 5])
def test_whole_table(spark, parts):
    lib = Tokenizer.from_file(m.TOKENIZER)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    docs = [(d.doc_id, lib.encode(d.text or "", add_special_tokens=False).ids + [1], d.source) for d in df.collect()]
    check_packing(m.digest(m.pack(df.repartition(parts))).collect(), docs)


def test_cases(spark):
    df = spark.createDataFrame([(1, None, None, 5), (2, "", "a", 5), (3, "hello world", "b", 5), (4, "x", "a", 5)], "doc_id long, text string, source string, length int")
    lib = Tokenizer.from_file(m.TOKENIZER)
    docs = [(r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [1], r.source) for r in df.collect()]
    check_packing(m.digest(m.pack(df)).collect(), docs)
    twice = m.digest(m.pack(df.union(df))).collect()
    assert sum(p.length for p in twice) == 2 * sum(len(x) for _, x, _ in docs)
    assert m.digest(m.pack(df.limit(0))).count() == 0


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(m, "QUEUES", 3)
    df = spark.range(300).selectExpr("id as doc_id", "concat('word ', id, ' more words') as text", "concat('s', id % 9) as source")
    got = m.digest(m.pack(df)).collect()
    at = defaultdict(list)
    for p in got:
        at[p.sequence_id].append((p.offset, p.length))
    for ps in at.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(ps), sorted(ps)[1:]))
    assert len({p.doc_id for p in got}) == 300


def test_every_source_has_a_queue(spark, monkeypatch):
    monkeypatch.setattr(m, "QUEUES", 3)
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 90_000, 40).tolist()
    mix, q = m.Mixture(sizes), np.arange(40)
    got = np.array([mix.at(np.full(40, w), q)[0] for w in range(mix.windows + 1)])
    assert (got.sum(1) == np.minimum(np.arange(mix.windows + 1) * m.WINDOW, mix.total)).all()
    assert (np.diff(got, axis=0) >= 0).all() and got[-1].tolist() == sizes
    assert np.abs(np.diff(got, axis=0)[:-1] - m.WINDOW * np.array(sizes) / mix.total).max() < 4
    lib = Tokenizer.from_file(m.TOKENIZER)
    df = spark.range(600).selectExpr("id as doc_id", "repeat(concat('word ', id, ' more words '), 10 + cast(id % 7 as int)) as text", "if(id % 9 = 0, null, concat('s', id % 9)) as source")
    docs = [(d.doc_id, lib.encode(d.text, add_special_tokens=False).ids + [1], d.source) for d in df.collect()]
    check_packing(m.digest(m.pack(df.repartition(4), alpha=1)).collect(), docs, 1)
    over = m.Mixture(sizes, alpha=0.5)
    got = np.array([over.at(np.full(40, w), q)[0] for w in range(over.windows + 1)])
    assert (got.sum(1) == np.minimum(np.arange(over.windows + 1) * m.WINDOW, over.total)).all() and got[-1].tolist() == sizes
    share = np.array(sizes) ** 0.5
    assert np.abs(got[1] - m.WINDOW * share / share.sum()).max() < 4


def test_shares_of_small_sources(spark, monkeypatch):
    monkeypatch.setattr(m, "QUEUES", 3)
    df = spark.range(900).selectExpr("id as doc_id", "repeat(concat('word ', id, ' more words '), if(id % 9 < 2, 5, 20)) as text", "concat('s', id % 9) as source")
    got = m.digest(m.pack(df, shares={"s0": 3, "s1": 1, "s2": 0})).collect()
    first = [p for p in got if p.sequence_id == 0]
    count = {s: sum(p.length for p in first if p.source == s) for s in {p.source for p in first}}
    assert set(count) == {"s0", "s1"} and abs(count["s0"] - 1536) <= 1
    last_named = max(p.sequence_id for p in got if p.source in ("s0", "s1"))
    assert min(p.sequence_id for p in got if p.source not in ("s0", "s1")) >= last_named
    assert {p.doc_id for p in got} == set(range(900))
