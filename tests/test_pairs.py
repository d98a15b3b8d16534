"""Joins whose comparisons see both sides: dealt over tasks, with the same results."""

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillfact.engine import Engine

# decimals whose nearest doubles are the same, copies, ends of the range
LEFT = [(k, n, Decimal(x)) for k, (n, x) in enumerate([(1, "0.1"), (1, "0.100000000000000001"), (1, "5"), (2, "-7.25"), (2, "99999999999999999999.5"), (3, "1"), (1, "0.1"), (1, "-3")])]
RIGHT = [(k, n, Decimal(x)) for k, (n, x) in enumerate([(1, "0.1"), (1, "0.100000000000000002"), (1, "0.099999999999999999"), (2, "99999999999999999999.499999999999999999"), (2, "-8"), (4, "1"), (1, "0.1"), (1, "9007199254740993")])]
WHOLE = [(0, 1, 9007199254740992), (1, 1, 9007199254740993), (2, 1, 5), (3, 2, -8), (4, 3, 1)]
HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "!=": lambda a, b: a != b}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine.of(spark)
    for name, rows, kind in (("left", LEFT, "decimal(38,18)"), ("right", RIGHT, "decimal(38,18)"), ("whole", WHOLE, "bigint")):
        e.catalog.register(name, spark.createDataFrame(rows, f"k long, n long, x {kind}"))
    return e


@pytest.mark.parametrize("other,rows", [("right", RIGHT), ("whole", WHOLE)])
@pytest.mark.parametrize("op", list(HOLDS))
@pytest.mark.parametrize("shared", [True, False])
def test_same_pairs(engine, op, other, rows, shared):
    n = "N" if shared else "_"
    same = Decimal if other == "right" else lambda v: None if op == "!=" else Decimal(v)  # an integer equals no decimal
    fits = lambda l, r: (not shared or l[1] == r[1]) and (same(r[2]) is None or HOLDS[op](l[2], same(r[2])))
    pairs = [(l[0], r[0]) for l in LEFT for r in rows if fits(l, r)]
    alone = [l[0] for l in LEFT if not any(fits(l, r) for r in rows)]
    got = lambda text: Counter(map(tuple, engine.query(text).collect()))
    test = f"left(L, {n}, X)", f"{other}(R, {n}, Y)", f"X {op} Y"
    core = engine.query(", ".join(test)).select("L", "R")
    assert Counter(map(tuple, core.collect())) == Counter(pairs)
    assert got(f"find L, R\nwhere\n  {test[0]}\n  optional\n    {test[1]}\n    {test[2]}") == Counter(pairs + [(l, None) for l in alone])


@pytest.mark.parametrize("text", ["big(C, N, A), small(S, N, B), A < B", "find S, C\nwhere\n  small(S, N, B)\n  optional\n    big(C, N, A)\n    A > B"])
def test_pairs_of_one_key_in_one_file_are_made_by_many_tasks(spark, tmp_path, text):
    e = Engine.of(spark)
    for name, n in (("big", 2000), ("small", 400)):
        path = str(tmp_path / name)
        spark.range(n).select(F.col("id").alias("k"), F.lit(7).alias("n"), (F.col("id") % 101).cast("double").alias("x")).coalesce(1).write.parquet(path)
        e.catalog.register(name, spark.read.parquet(path), distinct=False, complete=True)
    df = e.query(text)
    assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 3 and max(shares) < sum(shares) / 2  # of 8 shuffle partitions


def test_decimals_as_doubles(engine):
    text = "left(L, N, X), right(R, N, Y), X < Y"
    rows = lambda df: Counter(map(tuple, df.select("L", "R", F.col("X").cast("double"), F.col("Y").cast("double")).collect()))
    assert dict(engine.query(text, doubles=True).dtypes)["X"] == "double" and rows(engine.query(text, doubles=True)) == rows(engine.query(text))


def test_optional_rows_of_one_hot_row_are_made_by_many_tasks(spark):
    e = Engine.of(spark)
    e.catalog.register("hot", spark.createDataFrame([(0, 7, 4.5), (1, 8, 0.0), (2, 7, 100.0)], "k long, n long, x double"))
    e.catalog.register("big", spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") >= 0, 7).otherwise(8).alias("n"), (F.col("id") % 101).cast("double").alias("x")), distinct=False, complete=True)
    df = e.query("find S, C\nwhere\n  hot(S, N, B)\n  optional\n    big(C, N, A)\n    A > B")
    want = [(0, k) for k in range(2000) if k % 101 > 4.5] + [(1, None), (2, None)]
    assert Counter(map(tuple, df.collect())) == Counter(want)
    shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares) * 0.8


@pytest.mark.parametrize("tests", [["Y > X"], ["Y <= X"], ["X < Y", "L != R"], ["X between Y and Y"], ["R < L"], ["L >= R"]])
def test_optional_comparisons_of_every_form(engine, tests):
    holds = {"Y > X": lambda l, r: r[2] > l[2], "Y <= X": lambda l, r: r[2] <= l[2], "X < Y": lambda l, r: l[2] < r[2], "L != R": lambda l, r: l[0] != r[0], "X between Y and Y": lambda l, r: l[2] == r[2], "R < L": lambda l, r: r[0] < l[0], "L >= R": lambda l, r: l[0] >= r[0]}
    want = []
    for l in LEFT:
        mine = [(l[0], r[0]) for r in RIGHT if l[1] == r[1] and all(holds[t](l, r) for t in tests)]
        want += mine or [(l[0], None)]
    lines = "\n    ".join(["right(R, N, Y)", *tests])
    assert Counter(map(tuple, engine.query(f"find L, R\nwhere\n  left(L, N, X)\n  optional\n    {lines}").collect())) == Counter(want)


@pytest.mark.parametrize("right", ["right(R, N, Y)\n    R < 0", "whole(R, 77, Y)"])
def test_optional_against_an_empty_side(engine, right):
    df = engine.query(f"find L, R\nwhere\n  left(L, N, X)\n  optional\n    {right}\n    X < Y")
    assert Counter(map(tuple, df.collect())) == Counter((l[0], None) for l in LEFT)
