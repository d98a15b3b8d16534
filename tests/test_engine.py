import random
from collections import Counter

import pytest
from reference_eval import Failed, run

from quillfact.engine import Engine, Limits
from quillfact.operators.relation import QueryError, as_json
from quillfact.plans import ast as A
from quillfact.plans import parse as P
from quillfact.plans.validate import InvalidQuery
from quillfact.sources.catalog import Catalog, CatalogError

ART = """created(tina_keane, she).
created(lynn_hershman, lorna).
shown_in(she, rewind_1995).
artist(tina_keane).
artist(lynn_hershman).
birth_year(tina_keane, @1951).
birth_year(lynn_hershman, @1941).
confidence(assertion_1, 0.92).
confidence(assertion_2, 0.50).
captured_at(capture_1, @2022-08-17T12:30:00Z).
captured_at(capture_2, @2023-01-01T00:00:00Z).
opened(exhibition_1, @2019-06-15).
opened(exhibition_2, @2020-01-01).
nationality(lynn_hershman, american).
parent(alice, bob).
parent(bob, carol).
person(p1).
person(p2).
organisation(o1).
nickname(p1, "Al").
value(item_1, 1979).
value(item_2, "unknown").
n(a, -5).
n(b, 0).
n(c, 5).
everything(a, "s", "s"@en, 1, 1.5, true, @1, @1-01, @0001-01-01, @0001-01-01T00:00:00Z, <a:b>)."""


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine.of(spark, limits=Limits(query_timeout=60.0))
    e.catalog.add_lines(ART)
    for p in e.catalog.predicates.values():
        p.df.cache()
    return e


@pytest.mark.parametrize(
    "text,n",
    [
        ("created(Artist, Work)", 2), ("birth_year(P, @1951)", 1), ("confidence(A, S), S >= 0.8", 1), ("birth_year(P, Y), Y >= 1945, Y < 1960", 1),
        ("opened(E, D), D between @2019-01-01 and @2019-12-31", 1), ("captured_at(C, D), D >= @2022-01-01T00:00:00Z, D < @2023-01-01T00:00:00Z", 1), ("birth_year(P, Y), Y between 1940 and 1945", 1),
        ("created(A, W), shown_in(W, E)", 1), ("birth_year(P, Y), Y = 1951", 0), ("birth_year(P, Y), 1941 <= Y", 2), ("parent(P, Q), parent(Q, R)", 1), ("n(X, V), V >= -3, V <= 3", 1),
        ("value(I, V), V = 1979", 1), ("value(I, V), V != 1979", 1), ("value(I, V), V > 1970", 1), ("no_such(X)", 0), ("parent(X)", 0), ("value(I, 1979.0)", 0), ("everything(_, _, _, _, _, _, _, _, _, _, _)", 1),
        ("everything(a, \"s\", \"s\"@en, 1, 1.50, true, @1, @1-01, @0001-01-01, @0001-01-01T01:00:00+01:00, <a:b>), artist(X), person(a)", None),
        ("find A, N\nwhere\nartist(A)\noptional\nnationality(A, N)", 2), ("find A\nwhere\nartist(A)\nnot\ncreated(A, lorna)", 1), ("find A\nwhere\nartist(A)\neither\nbirth_year(A, @1951)\nor\nnationality(A, american)", 2),
        ("find A\nwhere\nartist(A)\nnot", None), ("find A\nwhere\nartist(A)\noptional", None),
    ],
)
def test_counts(engine, text, n):
    if n is None:
        with pytest.raises(InvalidQuery):
            engine.query(text)
    else:
        assert engine.query(text).count() == n


def test_order_and_nulls(engine):
    for way in ("asc", "desc"):
        rows = engine.query(f"find P, N\nwhere\nperson(P)\noptional\nnickname(P, N)\norder by N {way}").collect()
        assert [r.N for r in rows] == ["Al", None]
    assert [r.A for r in engine.query("find A\nwhere\nartist(A)\norder by A descending\nlimit 1").collect()] == ["tina_keane"]
    assert [r.X for r in engine.query("find X, V\nwhere\nn(X, V)\norder by V desc\noffset 1\nlimit 1").collect()] == ["b"]


@pytest.mark.parametrize(
    "text",
    ["opened(E, D), D < 1979", "birth_year(P, Y), confidence(A, S), Y < S", "artist(A), created(A, W), A < W", "value(I, V), n(X, W), V > W", "person(P), nickname(P, N), Z < 3", "find P\nwhere\nperson(P)\noptional\nnickname(P, N)\nN = \"Al\"\n"],
)
def test_comparisons_that_fail(engine, text):
    if text.startswith("find"):
        assert engine.query(text).count() == 2  # the test belongs to the group
        q = A.Query((A.Pattern("person", (A.Var("P"),)), A.Optional_((A.Pattern("nickname", (A.Var("P"), A.Var("N"))),)), A.Compare(A.Var("N"), "=", A.Var("N"))), ("P",))
        with pytest.raises(QueryError, match="Unbound variable in comparison: N"):
            engine.relation(q)
        return
    with pytest.raises((QueryError, InvalidQuery)):
        q = P.core(text)
        engine.relation(q).df.collect()


def test_failing_rows_that_joins_discard(engine):
    # the pair that can't be compared is no row of the join
    assert engine.relation(P.core("value(item_1, V), n(X, W), V > W")).df.count() == 3


def codes(engine, text, language="dsl"):
    out = engine.run_query(text, language, "validate")
    return [e["code"] for e in out.body["errors"]]


def test_validation(engine):
    assert codes(engine, "find X\nwhere\n artst(X)\n parent(X)\n birth_year(X, 3)\n opened(X, D)\n D >= 1970\n not\n person(Z)\norder by W") == [
        "unknown_predicate", "arity_mismatch", "literal_type_mismatch", "comparison_type_mismatch", "unsafe_negation", "unbound_order_variable", "disconnected_query",
    ]
    assert codes(engine, "find Q\nwhere\nperson(P)") == ["unbound_projection"] and codes(engine, "find X\nwher") == ["syntax_error"]
    assert codes(engine, "person(P), organisation(O)", "core") == ["disconnected_query"] and codes(engine, "P(X)", "core") == ["invalid_predicate_name"] and codes(engine, "X < 3", "core") == ["invalid_syntax"]
    warned = engine.run_query("find I\nwhere\nvalue(I, 1979)", "dsl", "validate").body
    assert warned["valid"] and warned["warnings"][0]["code"] == "heterogeneous_position"
    groups = engine.run_query("person(P), organisation(O)").body["errors"][0]["groups"]
    assert groups == [["person(P)"], ["organisation(O)"]]


def test_explain(engine):
    body = engine.run_query("find A, W\nwhere\ncreated(A, W)\nbirth_year(A, Y)\nY > 1945\noptional\nshown_in(W, E)\nnot\ncreated(A, lorna)\norder by A\nlimit 5", "dsl", "explain").body
    assert [p["operation"] for p in body["plan"]] == ["range_index_lookup", "join", "optional_join", "not_exists", "filter", "project", "sort", "limit"]
    assert body["planText"].split("\n")[0] == "birth_year: range_index(position=1, lower=exclusive:1945, upper=unbounded)"
    assert body["normalizedCoreQuery"] == {"patterns": ["created(A, W)", "birth_year(A, Y)", "shown_in(W, E)", "created(A, lorna)"], "comparisons": ["Y > 1945"]}
    assert "Physical Plan" in engine.explain("created(A, W), shown_in(W, E)")


def test_service(engine):
    out = engine.run_query("artist(A)", offset=1, limit=1).body
    assert (out["count"], out["total"], out["offset"], out["limit"]) == (1, 2, 1, 1)
    join = engine.run_query("created(A, W), shown_in(W, E)").body
    assert "total" not in join and join["variables"] == ["A", "E", "W"] and join["results"][0]["E"] == {"type": "atom", "value": "rewind_1995"}
    rows = engine.run_query("find A, N\nwhere\nartist(A)\noptional\nnationality(A, N)\norder by A", "dsl").body["results"]
    assert rows[1] == {"A": {"type": "atom", "value": "tina_keane"}, "N": None}
    assert engine.run_query("x" * 20_001).http_status == 413 and engine.run_query("p(X)", "sql").body["code"] == "unknown_language" and engine.run_query("p(X)", "core", "do").body["code"] == "unknown_action"
    assert engine.run_query("opened(E, D), D < 1979").body["code"] == "execution_error"
    assert engine.run_query("artist(A)", limit=0).body["errors"][0]["code"] == "invalid_limit"
    assert [p["name"] for p in engine.describe(q="AGE")["predicates"]] == [] and engine.describe(names=["value"])["predicates"][0]["arguments"][1]["types"] == ["integer", "string"]
    assert engine.list_predicates(1)["predicates"][0]["sample_count"] == 1 and "samples_per_predicate" not in engine.list_predicates(101)
    assert engine.facts("artist")["count"] == 2 and engine.facts("nothing")["count"] == 0
    env = engine.run_query("artist(A)", "core", "validate").body["environmentFingerprint"]
    engine.catalog.add_lines("extra(a).")
    assert engine.run_query("artist(A)", "core", "validate").body["environmentFingerprint"] != env
    with pytest.raises(ValueError):
        Limits.from_json({"max_results": 0})
    assert Limits.from_json({"query_timeout": 2}).query_timeout == 2


def test_loading_and_store(spark, tmp_path):
    folder = tmp_path / "data" / "predicates"
    folder.mkdir(parents=True)
    (folder / "p.pl").write_text("p(a, 1).\np(a, 1).\nx(b, 2.5).\nnot_closed(\n% c\np(c, @10000-01-01).\n")
    (folder / "q").write_text("q(a).\nq(a, b).\n")
    (folder / "README.md").write_text("no(a).")
    e = Engine.of(spark)
    assert e.catalog.compile_folder(str(tmp_path / "data")) == {"p": "written, 4 facts; several types at position 1", "q": "arity mismatch, not written"}
    assert e.query("p(X, Y)").count() == 3
    e.catalog.add_lines('r(a, @10000-01-01).\nr(b, @2020-01-01).\nt("x, \\"y\\"\\n", "v"@de, <a:b>, 2.0, @-5-01).')
    assert e.query("r(X, D), D > @2021-01-01").count() == 1 and e.query("r(X, @10000-01-01)").count() == 1
    e.catalog.save(str(tmp_path / "store"))
    again = Engine(type(e.catalog).open(spark, str(tmp_path / "store")))
    for q in ("p(X, Y)", "r(X, D), D > @2021-01-01", "t(A, B, C, D, E)"):
        assert sorted(map(str, again.query(q).collect())) == sorted(map(str, e.query(q).collect()))
    from quillfact.sources.facts import write_facts

    write_facts(e.catalog.predicates["t"].structs(), "t", str(tmp_path / "out"))
    back = Engine.of(spark)
    back.catalog.load_file(str(tmp_path / "out"))
    assert back.run_query("t(A, B, C, D, E)").body["results"] == e.run_query("t(A, B, C, D, E)").body["results"]
    (tmp_path / "q.txt").write_text("p(X, Y)\n# c\np(X\n")
    assert [o.status for _, o in e.run_file(str(tmp_path / "q.txt"))] == ["ok", "invalid"]


def test_saving_to_the_store_that_is_read(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(CatalogError):
        Catalog.open(spark, store)
    first = Catalog(spark)
    first.save(store)
    assert not Catalog.open(spark, store).predicates
    first.add_lines("p(a, 1).\np(b, 2).\nq(x).\nflag().\nflag().")
    first.save(store)
    reader, writer = Engine(Catalog.open(spark, store)), Catalog.open(spark, store)
    (tmp_path / "more.pl").write_text("p(b, 2).\np(c, 3).\nz(k).\nz(\nmore7(a).\n")
    assert writer.load_file(str(tmp_path / "more.pl")) == {"more7": "written, 1 facts", "p": "written, 2 facts", "z": "written, 1 facts"}
    assert [r.line for r in writer.problems[str(tmp_path / "more.pl")].collect()] == ["z("]
    writer.save(store)
    assert reader.query("p(X, Y)").count() == 2  # what was opened stays as it was
    last = Engine(Catalog.open(spark, store))
    assert sorted(r.Y for r in last.query("p(X, Y)").collect()) == [1, 2, 3]
    assert [last.query(f"{p}(X)").count() for p in ("q", "z", "more7")] == [1, 1, 1]
    assert last.catalog.predicates["flag"].df.count() == 1
    assert last.catalog.predicates["q"].home == reader.catalog.predicates["q"].home  # not written again


def test_manifest(engine):
    got = {(r.position, r.type): (r["count"], r.distinct_count, r.min, r.max) for r in engine.catalog.manifest("n").collect()}
    assert got == {(0, "atom"): (3, 3, None, None), (1, "integer"): (3, 3, "-5", "5")}


def test_listings_of_a_store_read_no_facts(spark, tmp_path):
    store = str(tmp_path / "store")
    made = Engine.of(spark)
    made.catalog.add_lines('p(a, 1).\np(b, 2.5).\np(c, "x").\nflag().\nm(@2020-01-01, 7).')
    want = made.describe(), made.list_predicates(100), {n: sorted(map(str, made.catalog.manifest(n).collect())) for n in ("p", "flag", "m")}
    made.catalog.save(store)
    for f in (tmp_path / "store" / "facts").rglob("*.parquet"):
        f.unlink()
    opened = Engine(Catalog.open(spark, store))
    assert opened.describe() == want[0] and opened.list_predicates(100) == want[1]
    assert {n: sorted(map(str, opened.catalog.manifest(n).collect())) for n in ("p", "flag", "m")} == want[2]
    assert [opened.catalog.predicates[n].count() for n in ("p", "flag", "m")] == [3, 1, 1]


def test_facts_added_to_a_store_are_counted_anew(spark, tmp_path):
    store = str(tmp_path / "store")
    made = Catalog(spark)
    made.add_lines("p(a).\np(b).\nq(1).")
    made.save(store)
    more = Catalog.open(spark, store)
    more.add_lines("p(b).\np(c).")
    more.save(store)
    last = Catalog.open(spark, store)
    assert (last.predicates["p"].count(), last.predicates["q"].count()) == (3, 1)
    assert last.predicates["q"].known == made.predicates["q"].known  # not counted again
    assert [r["count"] for r in last.manifest("p").collect()] == [3] and last.predicates["p"].sample(5).count() == 3


@pytest.mark.parametrize("query, message", [
    ("opened(X, D), D < 1979", "date and integer 1979 have no common order."),  # a range access asks for the types alone
    ("opened(X, D), born(Y, Z), D < Z", "date 2019-06-15 and year 1951 have no common order. Write both as years, e.g. @1970, or both as days, e.g. @1970-01-01."),
    ("mixed(X, V), born(Y, Z), V < Z", "string unknown and year 1951 have no common order."),
])
def test_comparison_errors_name_the_values(spark, query, message):
    made = Engine.of(spark)
    made.catalog.add_lines('opened(show, @2019-06-15).\nborn(show, @1951).\nmixed(a, "unknown").')
    with pytest.raises(QueryError) as e:
        made.query(query).collect()
    assert str(e.value) == message


def test_distinct_by_several_hidden_keys(spark):
    rng = random.Random(3)
    facts = {(f"g{rng.randint(0, 5)}", rng.choice(["1", "2.5", '"t"', '"s"', "@2020-01-01"]), rng.randint(0, 4)) for _ in range(60)}
    made = Engine.of(spark)
    made.catalog.add_lines("".join(f"p({g}, {v}, {n}).\n" for g, v, n in facts))
    family = {"1": (0, 1.0), "2.5": (0, 2.5), "@2020-01-01": (2, 0), '"s"': (9, 0), '"t"': (9, 1)}
    want = {}
    for g, v, n in facts:
        key = (-n, *family[v])
        want[g] = min(want.get(g, key), key)
    df = made.query("find distinct G\nwhere\n  p(G, V, N)\norder by N desc, V")
    ranked = [want[r.G] for r in df.collect()]
    assert ranked == sorted(want.values())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Join" not in plan


def test_random_queries(spark):
    """Random queries on random small facts against the plain evaluator."""
    rng = random.Random(11)
    engine = Engine.of(spark, limits=Limits(query_timeout=60.0))
    values = ["a", "b", "1", "2", "2.0", "@2", '"a"', "3"]
    lines = [f"p({rng.choice(values[:4])}, {rng.choice(values)})." for _ in range(8)] + [f"q({rng.choice(values[:4])}, {rng.choice(values[2:4])})." for _ in range(6)] + [f"r({v})." for v in values[:3]]
    engine.catalog.add_lines(lines)
    for p in engine.catalog.predicates.values():
        p.df.cache().count()
    facts: dict = {}
    for x in dict.fromkeys(P.fact(x) and (P.fact(x)[0], tuple(P.fact(x)[1])) for x in lines):
        facts.setdefault(x[0], []).append(x[1])
    var = lambda: A.Var(rng.choice("XYZ"))

    def pattern():
        name, n = rng.choice([("p", 2), ("q", 2), ("r", 1)])
        return A.Pattern(name, tuple(var() if rng.random() < 0.8 else A.Wild() if rng.random() < 0.5 else A.Lit(P.value(P.tokens(rng.choice(values))[0])) for _ in range(n)))

    def test():
        return A.Compare(var(), rng.choice(["=", "!=", "!="]), var() if rng.random() < 0.6 else A.Lit(P.value(P.tokens(rng.choice(values))[0])))

    def body():
        return tuple(pattern() for _ in range(rng.randint(1, 2))) + ((test(),) if rng.random() < 0.3 else ())

    checked = failed = 0
    for _ in range(45):
        clauses = [pattern() for _ in range(rng.randint(1, 2))]
        for _ in range(rng.randint(0, 2)):
            clauses.append(rng.choice([lambda: A.Optional_(body()), lambda: A.Not_(body()), lambda: A.Either((body(), body()))])())
        if rng.random() < 0.3:
            clauses.append(test())
        q = A.Query(tuple(clauses))
        try:
            want = Counter(tuple(sorted((v, x.type, x.text) for v, x in e.items() if x is not None)) for e in run(clauses, facts, {}))
        except Failed:
            failed += 1
            with pytest.raises(QueryError):
                engine.relation(q).df.collect()
            continue
        rel = engine.relation(q)
        import json

        got = Counter(tuple(sorted((v, x["type"], x["value"]) for v, x in json.loads(r["value"]).items())) for r in as_json(rel, False).collect())
        assert got == want, str(clauses)
        checked += 1
    assert checked > 25
