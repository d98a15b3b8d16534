import random
from collections import Counter

import duckdb
import pytest

from quillfact.llm import op9_quotes as m

COLS = ["conv_id", "turn", "role", "text", "n_quoted", "max_level", "n_linked", "reply_to", "thread", "depth", "position"]
SCHEMA = "conv_id long, turn long, role string, text string"


def oracle(df):
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    return Counter(map(tuple, con.execute(f"SELECT {', '.join(COLS)} FROM ({m.ORACLE_SQL})").fetchall()))


def got(df):
    return Counter(tuple(r) for r in m.link(df).select(COLS).collect())


def test_links_levels_and_order(spark):
    rows = [
        (1, 0, "user", "Alpha line\nBeta  line"),
        (1, 1, "a", "> alpha LINE\nmy answer"),
        (1, 2, "user", "new topic"),
        (1, 3, "a", "On Monday, X wrote:\n>> Alpha line\n> my  answer\nnested\n"),
        (1, 4, "a", "> new topic\r\n>unknown\nre topic"),
        (1, 5, "a", "> > beta line\ndeep only"),
        (2, 0, "a", "> alpha line\nother conversation"),
    ]
    out = {(r.conv_id, r.turn): r for r in m.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[1, k].reply_to for k in range(6)] == [None, 0, None, 1, 2, 0]
    assert [out[1, k].position for k in range(6)] == [0, 1, 4, 2, 5, 3]
    assert [out[1, k].depth for k in range(6)] == [0, 1, 0, 2, 1, 1]
    assert out[1, 3].text == "nested" and out[1, 3].max_level == 2 and out[1, 3].n_quoted == 2
    assert out[2, 0].reply_to is None and out[2, 0].text == "other conversation"


@pytest.mark.parametrize("step", [4096, 3])
def test_random_conversations(spark, monkeypatch, step):
    monkeypatch.setattr(m, "STEP", step)
    rng = random.Random(4)
    said = [f"line number {k}" for k in range(12)] + ["", "On day one wrote:", "é Ü x"]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 14)):
            lines = [rng.choice(["", "", "> ", ">", ">> ", " > >"]) + rng.choice(said) for _ in range(rng.randint(0, 5))]
            rows.append((c, t, rng.choice(["user", "a"]), "\n".join(lines)))
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (5, 1, "a", None), (6, 90, "a", "> line number 3"), (6, 91, None, " ")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as thread", "2 as level", "3 as lines")
    assert got(df) == oracle(df)


def test_long_chain(spark):
    rows = [(1, t, "u", (f"> message {t - 1}\n" if t else "") + f"message {t}") for t in range(70)]
    out = m.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.thread == 0 and r.depth == r.turn == r.position for r in out)


def test_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "u", "a"), (1, None, "u", "> a"), (None, None, None, None), (1, 2, "u", "> a\nb")], SCHEMA)
    out = m.link(df).collect()
    assert len(out) == 4 and sorted(r.text for r in out) == ["", "", "a", "b"]
    assert [r.position for r in out if r.conv_id == 1 and r.turn == 2] == [0] and sum(r.position is None for r in out) == 3
    assert m.link(df.limit(0)).count() == 0


def test_native_plan(spark):
    plan = m.op9_quote_linking(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(df) == oracle(df)


def test_very_long_message(spark):
    long = "\n".join(f"line {k} of a long message" for k in range(60_000))
    rows = [(1, 0, "user", long), (1, 1, "a", "> line 59999 of a long message\nyes"), (1, 2, "user", "\n".join(f"> {x}" for x in long.split("\n")[:30_000]) + "\nall of it")]
    out = {r.turn: r for r in m.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0].text == long and out[1].reply_to == 0 and out[1].text == "yes"
    assert out[2].reply_to == 0 and out[2].n_linked == 30_000 and out[2].text == "all of it"
