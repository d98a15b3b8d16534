"""Every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quillfact import checks
from quillfact import queries as Q

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(names), Counter(tuple(near(r[k]) for k in order) for r in data)


QUERIES = Q.queries() | {name: query for name, (query, _) in checks.CHECKS.items()}
SQL = Q.oracle_sql() | {name: sql for name, (_, sql) in checks.CHECKS.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want


@pytest.mark.parametrize(
    "text,pushed",
    [
        ("order_year(O, Y), Y >= 1996", ["GreaterThanOrEqual(o_orderdate"]), ("order_year(O, @1996)", ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"]),
        ("order_month(O, M), M between @1996-11 and @1997-02", ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"]), ("part_price(P, V), V >= 950", ["GreaterThanOrEqual(p_retailprice"]),
        ("measure(E, V), V = click", ["EqualTo(event_type,click)"]), ("measure(E, V), V >= 90", ["GreaterThanOrEqual(value"]),
    ],
)
def test_filters_reach_the_scan(spark, text, pushed):
    from quillfact.engine import Engine

    plan = Engine(Q.catalog(spark, SF, text)).query(text)._jdf.queryExecution().executedPlan().toString()
    assert all(p in plan for p in pushed), plan
    assert plan.count("FileScan") == 1  # of the parts of a union, only the one that can match


@pytest.mark.parametrize("bound", ["950", "950.0", "912.35", "912.3500001", "-1"])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_pushed_bounds_change_nothing(spark, bound, op):
    from quillfact.engine import Engine

    e = Engine(Q.catalog(spark, SF, "part_price(order_year("))
    got = e.query(f"part_price(P, V), V {op} {bound}").count()
    e.catalog.register("plain", e.catalog.predicates["part_price"].df.withColumnRenamed("a1", "v"), kinds={"v": "decimal"}, distinct=False)
    assert got == e.query(f"plain(P, V), V {op} {bound}").count()
