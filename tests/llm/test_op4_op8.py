import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillfact.llm import op4_langid as lid
from quillfact.llm import op8_quality as q

SF = "/root/testdata/sf0.01"


def plain_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    hit = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_stats_match_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()
    cases = [d.text for d in docs] + [None, "", " \n\t", "a b c d e a b c d e a b", "x " * 40, "é\x85ü z # | <", "a\nb\na\n\n \n", "a\r\na\n"]
    assert [q.text_stats(t or "")[:5] for t in cases] == [plain_stats(t) for t in cases]


def test_decision_list_learns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = q.fit(docs, labels)
    assert rules
    got = q.judge(docs, rules).join(labels, "doc_id").select("kept", "quality", "n_words").toPandas()
    good = got[(got.quality == 1) & (got.n_words >= 10)]
    assert good.kept.mean() > 0.98
    assert (~got[got.quality == 0].kept).mean() > 0.9


def test_rules_hold_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    got = q.judge(docs, q.fit(docs, labels.where(part != 1))).join(labels.where(part == 1), "doc_id").where("NOT base_failed").select("kept", "quality").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 100 and good.kept.mean() > 0.98
    assert len(bad) < 20 or (~bad.kept).mean() > 0.8


def plain_verdict(rules, t):
    """Whether one text is kept, from its characters and the list, without Spark."""
    n, chars, symbols, dups, repeated = plain_stats(t)
    w = (t or "").split() if (t or "").isascii() else re.findall(r"[^\x20\x09-\x0d]+", t or "")
    lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in (t or "").split("\n")))
    per = lambda k, by: k / max(by, 1)
    x = {
        "n_words": n, "mean_word_chars": per(chars, n), "symbols_per_word": per(symbols, n), "dup_line_share": per(dups, lines), "repeat_share": per(repeated, n),
        "upper_share": per(len(re.findall("[A-Z]", t or "")), chars), "digit_share": per(len(re.findall("[0-9]", t or "")), chars), "bangs_per_word": per((t or "").count("!"), n),
        "stops_per_word": per(len(re.findall("[.?]", t or "")), n), "distinct_share": per(len(set(w)), n), "words_per_line": per(n, lines),
    }
    if n < 10 or 100 * repeated > 20 * n:
        return False
    return not any(all(x[c.feature] > c.value if c.above else x[c.feature] <= c.value for c in rule) for rule in rules)


def test_kept_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.kept for r in q.op8_quality_rules(spark, SF).collect()}
    assert got == {i: plain_verdict(rules, t) for i, t in texts.items()}


def test_list_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.selectExpr("doc_id", "concat(text, ' more') as text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = q.fit(docs.select("doc_id", "text").union(other).repartition(7), labels)
    b = q.fit(other.union(docs.select("doc_id", "text")).repartition(3), labels)
    assert a == b and a


def test_more_rules_and_conditions_than_the_old_caps():
    rng = np.random.default_rng(1)
    x = {f"f{k}": rng.random(60_000) for k in range(2)}
    y = (np.floor(x["f0"] * 60) % 2 == 0)  # 30 intervals, a rule each
    rules = q.learn(x, y, np.arange(60_000) % 3 == 0)
    assert len(rules) > 24
    assert (np.logical_or.reduce([q._all(r, x, 60_000) for r in rules]) == y).mean() > 0.95


def test_very_long_text():
    words = " ".join(f"w{k}" for k in range(3_000_000))
    tail = " ".join(["again and once again now"] * 2)
    got = q.text_stats(words + " " + tail + "\n" + "line x\n" * 3)
    assert got[0] == 3_000_000 + 10 + 6 and got[3] == 2 and got[4] == 10 + 0
    for size in (1, 7, 1 << 20):
        q.PIECE, keep = size, q.PIECE
        assert [q.text_stats(t)[:5] for t in ("a b c d e a b c d e\nx\n\nx", "ab  cd\n", "\n", " ", "")] == [plain_stats(t) for t in ("a b c d e a b c d e\nx\n\nx", "ab  cd\n", "\n", " ", "")]
        q.PIECE = keep


def test_rules_equal_expression(spark):
    rng = np.random.default_rng(0)
    x = {"n_words": rng.integers(1, 100, 400).astype(float), "repeat_share": rng.random(400)}
    y = (x["n_words"] > 40) & (x["repeat_share"] <= 0.5)
    rules = q.learn(x, y, np.arange(400) % 3 == 0)
    assert (np.logical_or.reduce([q._all(r, x, 400) for r in rules]) == y).mean() > 0.95
    df = spark.createDataFrame([(int(a), int(b * 1000)) for a, b in zip(x["n_words"], x["repeat_share"])], "n_words long, n_repeat_words long")
    got = [r.v > 0 for r in df.select(q.verdict(rules).alias("v")).collect()]
    xs = {"n_words": x["n_words"], "repeat_share": np.array([int(b * 1000) / a for a, b in zip(x["n_words"], x["repeat_share"])])}
    assert got == list(np.logical_or.reduce([q._all(r, xs, 400) for r in rules]))
    assert [r.v for r in df.limit(1).select(q.verdict([]).alias("v")).collect()] == [0]


def test_quality_cases(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "one two three four five six seven eight nine ten", 3)], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([(1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    rules = q.fit(df, none)
    assert rules == []
    got = sorted(map(tuple, q.judge(df, rules).select("doc_id", "n_words", "base_failed", "kept").collect()), key=str)
    assert got == sorted([(None, 0, True, False), (1, 0, True, False), (1, 0, True, False), (2, 10, False, True)], key=str)
    assert q.judge(df.limit(0), rules).count() == 0


def test_langid_held_out_accuracy(spark):
    out = lid.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    test = out[out.held_out & (out.lang_pred != "und") & (out.text.str.split().str.len() >= 5)]
    assert len(test) > 200 and (test.lang == test.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all() and (out.held_out == [__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()


def test_langid_cases(spark):
    df = spark.createDataFrame(
        [(1, "the cat", "en", 1.0), (2, "le chat", "fr", 1.0), (3, None, "en", 0.0), (None, "the the", None, 0.0), (5, "12 %% ²", "fr", 0.0), (6, "", None, 0.0), (7, "THE", "fr", 0.0)],
        "doc_id long, text string, lang string, score double",
    )
    model = lid.Model([("en", "the", 9), ("en", "cat", 3), ("fr", "chat", 3), ("fr", "le", 9)])
    got = {r.doc_id: r.lang_pred for r in lid.identify(df, model).collect()}
    assert got == {1: "en", 2: "fr", 3: "und", None: "en", 5: "und", 6: "und", 7: "en"}
    assert {r.lang_pred for r in lid.identify(df, lid.Model([])).collect()} == {"und"}
    assert lid.train(df.limit(0)).langs == []
    assert lid.identify(df.limit(0), model).count() == 0


def plain_score(counts, text):
    """The score by plain loops: words first, then the longest n-grams that are known."""
    langs = sorted({lang for lang, _, _ in counts})
    parts = lambda w, n: [w] if n == 0 else list(w) if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = {n: {lang: Counter() for lang in langs} for n in range(5)}
    for lang, w, c in counts:
        for n in range(5):
            for g in parts(w, n):
                tables[n][lang][g] += c
    total = dict.fromkeys(langs, 0.0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for n in (0, 4, 3, 2, 1):
            known = [g for g in parts(w, n) if any(tables[n][lang][g] for lang in langs)]
            if known:
                size = len(set().union(*tables[n].values()))
                for lang in langs:
                    seen = sum(tables[n][lang].values())
                    total[lang] += sum(math.log((tables[n][lang][g] + 0.5) / (seen + 0.5 * size)) for g in known) / len(known)
                break
    best = min(langs, key=lambda x: (-total[x], x))
    return best, 1 / sum(math.exp(t - total[best]) for t in total.values())


def test_score_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcdefgh"[k : k + 5]) for _ in range(rng.randint(1, 6)))
    counts = list({(f"l{k}", word(k)): rng.randint(1, 9) for k in range(4) for _ in range(40)}.items())
    counts = [(lang, w, c) for (lang, w), c in counts]
    score = lid.Scorer(lid.Model(counts))
    for size in (1 << 16, 3):
        monkeypatch.setattr(lid, "CHUNK", size)
        for _ in range(300):
            text = " ".join(rng.choice(counts)[1] if rng.random() < 0.5 else word(rng.randrange(4)) + "é" * (rng.random() < 0.1) for _ in range(rng.randint(1, 12)))
            got, want = score(text), plain_score(counts, text)
            assert abs(got[1] - want[1]) < 1e-9 and (got[0] == want[0] or abs(want[1] - 0.5) < 1e-9), text


def test_trained_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = Counter((r.lang, w) for r in docs.where("lang IS NOT NULL").collect() for w in lid.words(r.text or ""))
    want = lid.Model([(lang, w, c) for (lang, w), c in seen.items()])
    got = lid.train(docs)
    assert got.langs == want.langs and got.keys == want.keys
    assert (got.at == want.at).all() and (got.lang == want.lang).all() and (got.more == want.more).all()


def test_every_language_and_every_word_is_learned(spark):
    """More languages than the old cap of 500, one text of words seen once each."""
    rows = [(k, f"mot{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} un{chr(97 + k % 26)}{chr(97 + k // 26)}", f"l{k:03}") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(df)
    assert model.langs == sorted(r[2] for r in rows)
    got = {r.doc_id: r.lang_pred for r in lid.identify(df, model).collect()}
    assert sum(got[k] == lang for k, _, lang in rows) == 700


def test_backoff_is_word_then_longest_gram():
    m = lid.Scorer(lid.Model([("en", "thing", 5), ("fr", "chose", 5)]))
    assert m.total(["thing"])[0] > m.total(["thing"])[1]
    assert m._grams("xing") == (4, [m.model.keys[4]["ing$"]])
    assert m._grams("zzz") == (0, []) and (m.total(["zzz"]) == 0).all()
