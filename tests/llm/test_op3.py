import random

import xxhash

from quillfact.llm import op3_simhash as m


def plain_fp(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in (text or ""))) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """rows: (id, fp) -> list of least reachable ids."""
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprint_matches_plain():
    rng = random.Random(1)
    ws = ["A", "b", "Éa", "x y", "zz"]
    cases = [None, "", " \t\n", "one", "One two", "a b c", "a b c d", "ß\x0b\x0cq r S t"] + [" ".join(rng.choice(ws) for _ in range(n)) for n in (5, 40, 300)]
    assert [m.fingerprint(t) for t in cases] == [plain_fp(t) for t in cases]


def test_chunks_agree(monkeypatch):
    t = " ".join(str(i * 7919 % 101) for i in range(500))
    want = m.fingerprint(t)
    monkeypatch.setattr(m, "CHUNK", 7)
    assert m.fingerprint(t) == want


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for k in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = m.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.comp for r in m.connected_components(edges).collect()}
    want = brute([(s, f) for s, f in zip(signed, fps)])
    assert [got.get(s, s) for s in signed] == want


def test_near_dedup_cases(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text + " x"), (None, text), (7, None), (8, ""), (7, None), (11, "lone")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, component_id int")
    got = sorted(map(tuple, m.near_dedup(df).select("doc_id", "fp", "component_id").collect()), key=str)
    fps = [m.fingerprint(t) for _, t in rows]
    want = brute([(d, f) for (d, _), f in zip(rows, fps)])
    assert got == sorted(((d, f - 2**64 if f >= 2**63 else f, c) for (d, _), f, c in zip(rows, fps, want)), key=str)
    assert m.near_dedup(df.limit(0)).count() == 0


def test_query_on_small_table(spark):
    got = m.op3_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fp = {d.doc_id: plain_fp(d.text) for d in docs}
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fp.items()}
    want = dict(zip(fp, brute(list(fp.items()))))
    assert {r.doc_id: r.component_id for r in got} == want
