"""Facts written and loaded: the quick way of common lines gives what the parser gives."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from quillfact.engine import Engine
from quillfact.sources import facts

PIECES = [
    "p", "orders", "Q_1", "_", "_x", "é", "(", ")", ",", ", ", " ", "\t", ".", '"', "\\", '"a b"', '"x, y)"', '"a\\"b"', '"x"@en', '""', '"é "', "0", "-0", "007", "12", "-5", "9" * 18, "9" * 19, "٣", "1.5",
    "-0.0", "00.50", "0.000000001", "1.1234567891", "5.", ".5", "-", "true", "false", "Tina", "abc", "@1996", "@1996-02", "@1996-02-29", "@1995-02-29", "@0000-01-01", "@12345-01-01", "@2020-01-01T00:00:00Z", "<http://a.b/c>", "%", "#", "\n", "\r",
]


def test_quick_way_is_the_parser():
    deal, quick = random.Random(5), 0
    good = ['"x, y)"', '""', '"é "', "-0", "007", "9" * 18, "1.5", "-0.0", "00.50", "0.000000001", "-7.250", "true", "Tina", "abc", "@1996-02-29", "@1995-02-29", "@0000-01-01"]
    lines = ["p()", "p(a,)", "p(,)", "p(a) .", " p(a).", "p(a)..", "p (a)", "p(a", "true(a)", "_(a)", "p(a))", "p((a))", "p(1 2)", "p(1a)", "p(a)\n", "p(a\n)"]
    for _ in range(20_000):
        args = [deal.choice(PIECES if deal.random() < 0.1 else good) for _ in range(deal.randint(1, 6))]
        lines.append(deal.choice(["orders(", "p (", "Q_1("]) + deal.choice([",", ", ", " ,\t"]).join(args) + deal.choice([").", ")", ").", ")..", ""]))
        lines.append("".join(deal.choices(PIECES, k=deal.randint(1, 9))))
    for line in lines:
        got = facts._easy(line)
        if got is not None:
            quick += 1
            want = facts._parsed(line)
            assert got == want and [str(v[2]) for v in got[2]] == [str(v[2]) for v in want[2]], line
    assert quick > 5_000


def _odd(spark):
    e = Engine.of(spark)
    rows = [(i, s, Decimal(x), day) for i, (s, x, day) in enumerate([("plain", "5", "1996-02-29"), ('a "quoted" \\ text\nof two lines, (x)', "-0.000000000000000001", "0001-01-01"), ("", "12345678901234567.25", "9999-12-31"), ("é\t@en", "0", "1970-01-01"), ("x", "-1.50", "1969-12-31")])]
    e.catalog.register("odd", spark.createDataFrame(rows, "i long, s string, x decimal(38,18), d string").withColumn("d", F.to_date("d")).withColumn("t", F.timestamp_micros(F.col("i") * 1_234_567)).withColumn("b", F.col("i") > 2))
    return e.catalog


def test_columns_are_written_as_their_structs(spark, tmp_path):
    c = _odd(spark)
    c.register("same", c.predicates["odd"].df.select("a0"), ["a0"])
    c.register("text", c.predicates["odd"].df.select("a1"), ["a1"])
    c.union("mix", ["same", "text"])
    for name in ("odd", "mix"):
        p = c.predicates[name]
        facts.write_facts(p.structs(), name, str(tmp_path / f"{name}1"))
        facts.write_facts(p.df, name, str(tmp_path / f"{name}2"), tuple(map(p.term, range(p.arity))))
        one, two = (sorted(r[0] for r in spark.read.text(str(tmp_path / f"{name}{k}")).collect()) for k in (1, 2))
        assert one == two and len(one) == p.count()


def test_loaded_facts_are_told_apart_by_their_own_columns(spark, tmp_path):
    path = str(tmp_path / "all.pl")
    lines = ['odd(1, "a", 2.50, @1996-02-29).', 'odd(01, "a", 2.5, @1996-02-29).', 'odd(1, "a", 2.500000000000000001, @1996-02-29).', 'mix(1).', 'mix("1").', 'mix(1.0).', 'mix(01).']
    with open(path, "w") as f:
        f.write("\n".join(lines))
    e = Engine.of(spark)
    e.catalog.load_file(path)
    df = e.catalog.predicates["odd"].df
    assert df.count() == 2 and e.catalog.predicates["mix"].df.count() == 3
    plan = df._jdf.queryExecution().optimizedPlan()
    while "Aggregate" not in plan.nodeName():
        plan = plan.children().head()
    for node in (plan, plan.children().head()):
        assert node.schema().simpleString().count("struct<") == 1  # of the row itself
