import random
from collections import defaultdict

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    schema = [(f.name, f.dataType) for f in docs.schema.fields]
    seen = {"documents": docs.collect()}
    cur = docs
    for name, stage in cp.STAGES[:-1]:
        cur = cp.materialize(stage(spark, cur, SF), "t")
        assert [(f.name, f.dataType) for f in cur.schema.fields] == schema
        seen[name] = cur.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert all(any(c.isalpha() for c in r.text) for r in seen["language_id"])
    good = {d for d, r in labels.items() if r.quality == 1} & ids["language_id"]
    long = {r.doc_id for r in seen["language_id"] if len(r.text.split()) >= 10}
    assert len(good & long & ids["quality_rules"]) > 0.98 * len(good & long)
    from quillfact.llm.op3_simhash import fingerprint

    fps = [fingerprint(r.text) for r in seen["near_dedup"]]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])

    assert ids["secret_scan"] == ids["near_dedup"]
    from quillfact.llm.op7_secrets import Scanner

    find = Scanner()
    assert not any(find(r.text) for r in seen["secret_scan"]) and any(find(r.text) for r in seen["near_dedup"])
    by = defaultdict(int)
    for p in cp.packing(spark, cur, SF).collect():
        by[p.doc_id] += p.length
    assert set(by) == ids["secret_scan"]


def test_empty_and_null_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "the cat sat on the mat with a hat and then it slept", "en", None, 5), (None, "the cat sat on the mat with a hat and then it slept", "en", None, 5), (2, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (df, df.limit(0)):
        cur = data
        for _, stage in cp.STAGES:
            cur = cp.materialize(stage(spark, cur, str(tmp_path)), "t")
        cur.count()


def test_near_dedup_keeps_one_row_a_class(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in ("red", "blue", "green"))
    rows = [(5, a), (5, b), (3, b), (5, c), (5, c), (7, c), (None, a), (None, "x y z"), (None, "X Y  z"), (None, "x y z"), (8, None), (8, None), (None, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, df, SF).collect()
    key = lambda r: (str(r[0]), str(r[1]).lower().split())
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted([(5, a), (3, b), (5, c), (None, got_text(got)), (8, None)], key=key)
    assert cp.near_dedup(spark, df.limit(0), SF).count() == 0


def got_text(rows):
    """The one text of several spellings that stayed."""
    (text,) = [r.text for r in rows if r.doc_id is None]
    return text


def _plans(spark):
    """Plans of all executions so far, by id."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {x.executionId(): x.physicalPlanDescription() for x in (runs.apply(i) for i in range(runs.size()))}


def test_near_dedup_broadcasts_no_table_over_the_bound(spark, monkeypatch):
    """The driver holds what is broadcast; every table here has more rows than the bound, though few bytes."""
    from quillfact.llm import common
    from quillfact.llm.op3_simhash import fingerprint

    monkeypatch.setattr(common, "BROADCAST_ROWS", 100, raising=False)
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(base)] * 2 + [(1000 + k, f"{t} more") for k, t in enumerate(base)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before = _plans(spark)
    got = cp.near_dedup(spark, df, SF).collect()
    run = [p for k, p in _plans(spark).items() if k not in before]
    assert any("SortMergeJoin" in p for p in run) and not any("Broadcast" in p for p in run)

    fps = {i: fingerprint(t) for i, t in rows}
    near = {1000 + k for k in range(300) if 0 < (fps[k] ^ fps[1000 + k]).bit_count() <= 2}
    assert len(near) > 60  # so that there are more links both ways than the bound
    gone = near | {1000 + k for k in range(300) if fps[k] == fps[1000 + k]}
    assert sorted(r.doc_id for r in got) == sorted(set(fps) - gone)
