"""Every operator on hard rows: nulls everywhere, empty and very long texts, ties,
repeated rows, clashing columns, no rows at all."""

import pytest

import corpus_pipeline as cp
from quillfact.llm import op2_bpe, op3_simhash, op4_langid, op5_html, op6_packing, op7_secrets, op8_quality, op10_warc

LONG = "".join(f"word{k % 977} and the other{k % 31}, " for k in range(60_000)) + "token = abcdef123456\n" * 5
SOLID = "x" * 300_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t", "one", LONG, LONG, SOLID, "a\x00b", "the cat sat on the mat again and again with the hat", "the cat sat on the mat again and again with the hat"]
    rows = [(k if k % 4 else None, t, "en" if k % 2 else None, "s" if k % 3 else None, None, 7, "x", 1.0) for k, t in enumerate(texts)]
    rows.append(rows[-1])
    rows.append((None,) * 8)
    # a column name of nearly every operator's own, with another type
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, component_id string, score double")
    return df.selectExpr("*", "1 as ids", "2 as spans", "3 as kept", "4 as n_words", "5 as `key`", "6 as part", "7 as `at`", "8 as n", "9 as queue", "10 as `_text`", "11 as `a.b`", "12 as doc_tokens").repartition(3)


def test_text_operators(docs):
    n = docs.count()
    for df in (docs, docs.limit(0)):
        want = n if df is docs else 0
        assert op2_bpe.roundtrip_digests(df).count() == want
        assert op2_bpe.decode(op2_bpe.encode(df)).count() == want
        assert op3_simhash.near_dedup(df).count() == want
        assert op4_langid.identify(df, op4_langid.train(df)).count() == want
        assert op7_secrets.scan(df).count() == want
        assert op8_quality.judge(df, op8_quality.fit(df, df.selectExpr("doc_id", "cast(null as int) as quality"))).count() == want
        pieces = op6_packing.pack(df).collect()
        assert len({p.sequence_id for p in pieces}) >= (1 if want else 0)
        assert sum(p.length for p in pieces) == sum(op6_packing.tokenized(df).select("n").toPandas()["n"])


def test_long_texts_are_read_whole(docs):
    spans = {len(r.spans) for r in op7_secrets.scan(docs).collect()}
    assert 5 in spans  # the secrets stand at the end of the long text
    assert op8_quality.text_stats(LONG)[0] == len(LONG.split()) and op8_quality.text_stats(SOLID)[0] == 1
    codec = op2_bpe.Codec()
    assert codec.encode(LONG + " end")[-1] == codec.encode("end")[-1]
    assert op4_langid.Scorer(op4_langid.Model([("en", "end", 3), ("fr", "word", 3)]))("zz " * 300_000 + "end")[0] == "en"


def test_pages(spark):
    rows = [(None, None, None), (1, "http://h/", "<p>" + "long text " * 100_000), (1, "http://h/", "<p>" + "long text " * 100_000), (2, "", ""), (3, "u", "<div>" * 3000 + "deep"), (4, "u", "<<<>>></p></p><p><table><td>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as template", "4 as digest", "5 as `least`", "6 as d", "7 as http")
    out = {(r.page_id, r.n_chars) for r in op5_html.extract(df).collect()}
    assert (1, 999_999) in out and (None, 0) in out and (2, 0) in out and (3, 4) in out
    path = op10_warc.write(df, op10_warc.scratch_path(spark, "edge"))
    got = op10_warc.read(spark, path).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) == 2


def test_pipeline(spark, docs, tmp_path):
    spark.createDataFrame([(None, None, None), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    cur = docs
    for name, stage in cp.STAGES:
        cur = cp.materialize(stage(spark, cur, str(tmp_path)), "edge")
        if name != "packing":
            assert cur.columns == cp.COLUMNS
    assert cur.count() > 0
