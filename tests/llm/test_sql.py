"""The operators' DuckDB SQL against their queries, on whole tables and on hard rows."""

import random

import duckdb
import pytest
from test_op1 import SCHEMA, clusters
from test_op10 import pages

from quillfact import llm
from quillfact.llm import op1_embedding_dedup, op10_warc


def check(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(map(tuple, df.select(*names).collect()), key=str)
    assert rows == sorted(got.fetchall(), key=str)
    return rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("conversations", "documents", "embeddings", "pages")}
    assert check(llm.queries()[name](spark, sf_dir), llm.oracle_sql()[name], **tables)


def test_base_columns_of_hard_texts(spark, tmp_path):
    rng = random.Random(5)
    bits = ["password: hunter22", "API_KEY='a.b/c=12345'", "apikey=x", "toKen = ſecret:abcdef1", "ſecret: abcdefgh", "toKen:abcdefgh", "AKIA" + "A1" * 9, "AKIAAKIA" + "Z" * 11, "0123456789abcdef" * 2, "deadbeef", "é", "字字 字", "\u00a0x", "\x1c", "\x85", "\n", "\n\n", "\r\n", " ", "\t", "a b c d e f", "a b c d e", "#$%", "secret=secret=secret"]
    texts = ["", None, " ", "\n", "a " * 40, "same\nsame\n same\n\n\nsame"] + ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "x"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i % 290, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for name in llm.BASE_COLUMNS:
        assert len(check(llm.queries()[name](spark, str(tmp_path)), llm.oracle_sql()[name], documents=df)) == len(texts)


def test_linked_vectors(spark):
    vectors = clusters(6, 6, 0.05) + clusters(7, 6, 0.02, each=3)
    rows = [(i % 190, v, i % 3) for i, v in enumerate(vectors + vectors[:40])]
    rows += [(500, None, 1), (501, vectors[0], None), (502, [0.0] * 64, 1), (503, vectors[0][:-1] + [None], 0), (504, vectors[0][:9], 0), (None, vectors[0], 0), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = check(op1_embedding_dedup.near_dedup(df), op1_embedding_dedup.ORACLE_SQL, embeddings=df)
    assert sum(r[1] > 0 for r in got) > 100


def test_archives_of_hard_pages(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    check(op10_warc.read(spark, op10_warc.write(df, f"{tmp_path}/w")), op10_warc.ORACLE_SQL, pages=df)
