"""Queries that show what the engine does besides answering: checks, explanations,
listings, paging, loading and storing.  Each gives rows that SQL can tell as well.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Limits, looks_like_dsl
from .functions import values as V
from .http import get, post
from .plans import parse as P
from .queries import catalog, shown
from .sources import facts as text
from .sources.catalog import Catalog

#: A few facts of every kind, for what does not depend on the tables.
SMALL = """made(tina, she).
made(lynn, lorna).
born(tina, @1951).
born(lynn, @1941).
opened(show_1, @2019-06-15).
seen(show_1, @2020-01-01T00:00:00Z).
score(a, 0.92).
mixed(x, 1979).
mixed(y, "unknown").
person(tina).
group(g)."""


def _small(spark: SparkSession) -> Engine:
    engine = Engine.of(spark, limits=Limits(query_timeout=120.0))
    engine.catalog.add_lines(SMALL)
    return engine


def _rows(spark: SparkSession, schema: str, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _values(names: str, rows) -> str:
    """SQL for constant rows."""
    shown_ = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown_, r)) + ')' for r in rows)}) AS t({names})"


#: query text -> codes of its problems
INVALID = {
    "made(X": ["syntax_error"], "find X\nwher": ["syntax_error"], "X < 3": ["invalid_syntax"], "Made(X, Y)": ["invalid_predicate_name"],
    "person(P), group(G)": ["disconnected_query"], "find X\nwhere\nmdae(X, Y)": ["unknown_predicate"], "find X\nwhere\nmade(X)": ["arity_mismatch"],
    "find X\nwhere\nborn(X, 3)": ["literal_type_mismatch"], "find X\nwhere\nopened(X, D)\nD >= 1970": ["comparison_type_mismatch"],
    "find X\nwhere\nmade(X, W)\nnot\nmade(X, Z)": ["unsafe_negation"], "find Q\nwhere\nperson(P)": ["unbound_projection"],
    "find P\nwhere\nperson(P)\norder by W": ["unbound_order_variable"], "find P\nwhere\nperson(P)\ngroup(G)": ["disconnected_query"], "find P\nwhere\nperson(P)\nlimit 0": ["syntax_error"],
    "find X\nwhere\nmade(X)\nmdae(X, Y)\norder by W": ["arity_mismatch", "unknown_predicate", "unbound_order_variable"],
    "find X\nwhere\nmixed(X, 1979)": [], "made(X, Y), born(X, Z)": [],
}


def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation finds in each of the queries above, in order."""
    engine, rows = _small(spark), []
    for q in INVALID:
        body = engine.run_query(q, "dsl" if looks_like_dsl(q) else "core", "validate").body
        rows += [(q, k, e["code"]) for k, e in enumerate(body["errors"])] or [(q, 0, "valid")]
    return _rows(spark, "query string, k int, code string", rows)


def validation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, suggestions, warnings and groups that a problem comes with."""
    engine = _small(spark)
    errors = lambda q, language: engine.run_query(q, language, "validate").body["errors"]
    unknown = errors("find X\nwhere\n  mad(X, Y)", "dsl")[0]
    arity = errors("find X\nwhere\nmade(X)", "dsl")[0]
    literal = errors("find X\nwhere\nborn(X, 3)", "dsl")[0]
    warned = engine.run_query("find X\nwhere\nmixed(X, 1979)", "dsl", "validate").body["warnings"]
    groups = errors("person(P), group(G)", "core")[0]["groups"]
    rows = [
        ("line", str(unknown["line"])), ("column", str(unknown["column"])), ("suggestions", ",".join(unknown["suggestions"])), ("expected", str(arity["expected"])), ("received", str(arity["received"])),
        ("position", str(literal["argumentPosition"])), ("expected_types", ",".join(literal["expectedTypes"])), ("received_type", literal["receivedType"]),
        ("warning", ",".join(w["code"] for w in warned)), ("groups", "|".join(",".join(g) for g in groups)),
    ]
    return _rows(spark, "what string, said string", rows)


PLANNED = "find A, W\nwhere\nmade(A, W)\nborn(A, Y)\nY > 1945\noptional\nopened(W, E)\nnot\nmade(A, lorna)\norder by A\nlimit 5"


def explain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _small(spark).run_query(PLANNED, "dsl", "explain").body
    return _rows(spark, "k int, operation string", enumerate(p["operation"] for p in body["plan"]))


def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _small(spark).run_query(PLANNED, "dsl", "explain").body
    return _rows(spark, "k int, line string", enumerate(body["planText"].split("\n")))


def normalized_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _small(spark).run_query(PLANNED, "dsl", "explain").body["normalizedCoreQuery"]
    return _rows(spark, "kind string, k int, clause string", [(kind, k, c) for kind in ("patterns", "comparisons") for k, c in enumerate(got[kind])])


def printed_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.core('p(X, _x, _, a, "s, t"), 1960 <= Y, Y between @1970 and Z')
    return _rows(spark, "k int, clause string", enumerate(map(str, q.clauses)))


LITERALS = {
    "alice": ("atom", "alice"), '"a b"': ("string", "a b"), '"x"@en-GB': ("lang_string", "x@en-GB"), "-42": ("integer", "-42"), "0.900": ("decimal", "0.9"), "true": ("boolean", "true"),
    "@1972": ("year", "1972"), "@1972-05": ("year_month", "1972-05"), "@1972-05-14": ("date", "1972-05-14"), "@2022-08-17T12:30:00+02:00": ("instant", "2022-08-17T10:30:00Z"), "<a:b>": ("uri", "a:b"),
    "@2021-02-29": None, "9223372036854775808": None, '"open': None,
}


def literal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for x in LITERALS:
        try:
            v = P.value(P.tokens(x)[0])
            rows.append((x, v.type, v.text, str(V.from_canonical(v.type, v.text) == v).lower()))
        except P.ParseError:
            rows.append((x, None, None, None))
    return _rows(spark, "literal string, type string, value string, back string", rows)


FACT_LINES = ["p(a, 1).", "p(a, Tina).", "% comment", "", "words only", "p(_).", "not_closed(a", 'q("x, \\"y\\"", @1951-02).']


def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a fact file, parsed on the executors; what is no fact has a problem."""
    got = text.from_lines(spark, FACT_LINES)
    args = F.array_join(F.transform("args", lambda a: F.concat(a["t"], F.lit(":"), a["c"])), "|")
    return got.select("line", "predicate", "arity", args.alias("args"), F.col("problem").isNotNull().alias("refused"))


def _folder(spark: SparkSession) -> str:
    from tempfile import mkdtemp

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        shared = mkdtemp(prefix="quillfact-")
    return f"{shared.rstrip('/')}/quillfact-{uuid.uuid4().hex}"


def written_and_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate written as text and loaded again."""
    path = f"{_folder(spark)}/orders.pl"
    orders = catalog(spark, sf_dir, "orders(").predicates["orders"]
    text.write_facts(orders.df, "orders", path, tuple(map(orders.term, range(orders.arity))))
    back = Engine.of(spark)
    back.catalog.load_file(path)
    return shown(back.query("orders(O, C, S, P, D, R)"))


def stored_and_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store saved, added to, and opened again: its last version."""
    path = f"{_folder(spark)}/store"
    first = catalog(spark, sf_dir, "nation(customer_segment(")
    first.save(path)
    more = Catalog.open(spark, path)
    more.add_lines('nation(99, "NOWHERE", 2).')
    more.save(path)
    return shown(Engine(Catalog.open(spark, path)).query("nation(N, Name, R)"))


def mixed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate of several types by way of the store."""
    path = f"{_folder(spark)}/store"
    catalog(spark, sf_dir, "measure(").save(path)
    return shown(Engine(Catalog.open(spark, path)).query("measure(E, V), V >= 90"))


def stored_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that a store keeps with its facts, of facts added to it as well."""
    path = f"{_folder(spark)}/store"
    catalog(spark, sf_dir, "nation(").save(path)
    more = Catalog.open(spark, path)
    more.add_lines('nation(99, "NOWHERE", 2).')
    more.save(path)
    return Catalog.open(spark, path).manifest("nation")


def stored_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a store's predicates, read from what is stored beside the facts."""
    path = f"{_folder(spark)}/store"
    catalog(spark, sf_dir, "orders(customer_segment(").save(path)
    got = Engine(Catalog.open(spark, path)).describe(examples=2)["predicates"]
    return _rows(spark, "name string, arity int, count long, examples long", ((p["name"], p["arity"], p["count"], len(p["examples"])) for p in got))


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    before = len(c.predicates)
    c.clear()
    return _rows(spark, "had int, has int, answer int", [(before, len(c.predicates), Engine(c).query("nation(N, X, R)").count())])


def predicate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(catalog(spark, sf_dir)).list_predicates()["predicates"]
    return _rows(spark, "name string, arity int", ((p["name"], p["arity"]) for p in got))


def predicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(catalog(spark, sf_dir, "region(nation(")).list_predicates(3)["predicates"]
    return _rows(spark, "name string, sample_count long, value string", ((p["name"], p["sample_count"], f[1]["value"]) for p in got for f in p["samples"]))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(catalog(spark, sf_dir, "nation(customer_segment(")).describe(q="N")["predicates"]
    return _rows(spark, "name string, count long, position int, types string", ((p["name"], p["count"], a["position"], ",".join(a["types"])) for p in got for a in p["arguments"]))


def dumped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(catalog(spark, sf_dir, "nation(")).facts("nation")
    return _rows(spark, "N long, Name string, R long", ((int(f[0]["value"]), f[1]["value"], int(f[2]["value"])) for f in got["facts"]))


def limited_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(catalog(spark, sf_dir, "customer("), Limits(max_results=17)).facts("customer")
    return _rows(spark, "count long, max_results long", [(got["count"], got["max_results"])])


def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one pattern with the total of all rows, and of a join without."""
    engine = Engine(catalog(spark, sf_dir, "customer_segment(customer_nation("), Limits(query_timeout=600.0))
    rows = []
    for q, offset, limit in (('customer_segment(C, "BUILDING")', 10, 7), ('customer_segment(C, "BUILDING")', None, 5), ('customer_segment(C, "BUILDING"), customer_nation(C, N)', 3, 4)):
        body = engine.run_query(q, offset=offset, limit=limit).body
        rows.append((q, body["count"], body.get("total"), len({r["C"]["value"] for r in body["results"]})))
    return _rows(spark, "query string, count long, total long, different long", rows)


def service_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the service calls, by action and route."""
    e = _small(spark)
    rows = [
        ("too long", e.run_query("x" * 20_001).body["code"]), ("action", e.run_query("person(P)", "core", "do").body["code"]), ("language", e.run_query("person(P)", "sql").body["code"]),
        ("offset", e.run_query("person(P)", offset=-1).body["errors"][0]["code"]), ("limit", e.run_query("person(P)", limit=0).body["errors"][0]["code"]),
        ("comparison", e.run_query("opened(E, D), D < 1979").body["code"]), ("unbound", e.run_query("person(P), Z < 3").body["code"]), ("valid", str(e.run_query("person(P)", "core", "validate").body["valid"]).lower()),
        ("route /", str(get(e, "/")[0])), ("route /nothing", str(get(e, "/nothing")[0])), ("route /query/person", str(get(e, "/query/person")[1]["count"])), ("post", str(post(e, "/query", b'{"query": "made(X, Y), born(X, Z)"}')[1]["count"])), ("post broken", str(post(e, "/query", b"{")[0])),
    ]
    e._slots = type(e._slots)(1)
    e._slots.acquire()
    rows.append(("busy", str(post(e, "/query", b'{"query": "person(P)"}')[0])))
    return _rows(spark, "asked string, outcome string", rows)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The environment's fingerprint depends on the schema, not on when it is asked for."""
    a, b = _small(spark), _small(spark)
    of = lambda e: e.run_query("person(P)", "core", "validate").body["environmentFingerprint"]
    same, hexed = of(a) == of(b), bool(re.fullmatch("sha256:[0-9a-f]{64}", of(a)))
    b.catalog.add_lines("extra(a).")
    return _rows(spark, "same boolean, hexadecimal boolean, other_schema_differs boolean", [(same, hexed, of(a) != of(b))])


def config_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for given in ({}, {"query_timeout": 2}, {"max_results": 0}, {"max_results": 1.5}, {"max_results": 7}):
        try:
            got = Limits.from_json(given)
            rows.append((str(given), int(got.query_timeout), got.max_results))
        except ValueError:
            rows.append((str(given), None, None))
    return _rows(spark, "given string, timeout int, results int", rows)


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders as counted by the engine's own calendar."""
    days = [r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).where("month(d) = 2 AND day(d) > 27").distinct().collect()]
    return _rows(spark, "day string, number long", ((str(d), V.epoch_day(d.year, d.month, d.day)) for d in days))


_PREDICATES = "customer 5,customer_nation 2,customer_segment 2,event 5,event_type 2,event_value 2,line_flag 2,line_part 2,line_ship 3,line_supplier 2,measure 2,nation 3,order_customer 2,order_date 2,order_month 2,order_year 2,orders 6,part 6,part_price 2,part_size 2,region 2,supplier 4,supplier_nation 2"
_ID = "sha256('{0}/{1}|' || {2})"

CHECKS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "validation_codes": (validation_codes, _values("query, k, code", [(q, k, c) for q, codes in INVALID.items() for k, c in enumerate(codes or ["valid"])])),
    "validation_details": (
        validation_details,
        _values("what, said", [("line", "3"), ("column", "3"), ("suggestions", "made,mixed"), ("expected", "2"), ("received", "1"), ("position", "1"), ("expected_types", "year"), ("received_type", "integer"), ("warning", "heterogeneous_position"), ("groups", "person(P)|group(G)")]),
    ),
    "explain_steps": (explain_steps, _values("k, operation", list(enumerate("range_index_lookup join optional_join not_exists filter project sort limit".split())))),
    "explain_text": (
        explain_text,
        _values("k, line", list(enumerate([
            "born: range_index(position=1, lower=exclusive:1945, upper=unbounded)", "made: equality_index(position=0, bound_variable=A)",
            "optional:", "  opened: equality_index(position=0, bound_variable=W)", "not_exists:", "  made: equality_index(position=1, value=lorna)",
        ]))),
    ),
    "normalized_query": (normalized_query, _values("kind, k, clause", [("patterns", 0, "made(A, W)"), ("patterns", 1, "born(A, Y)"), ("patterns", 2, "opened(W, E)"), ("patterns", 3, "made(A, lorna)"), ("comparisons", 0, "Y > 1945")])),
    "printed_clauses": (printed_clauses, _values("k, clause", [(0, "p(X, _x, _, a, s, t)"), (1, "1960 <= Y"), (2, "Y between 1970 and Z")])),
    "literal_values": (literal_values, _values("literal, type, value, back", [(x, *(v or (None, None)), "true" if v else None) for x, v in LITERALS.items()])),
    "fact_lines": (
        fact_lines,
        "SELECT line, predicate, CAST(arity AS INTEGER) AS arity, args, refused = 'yes' AS refused FROM ("
        + _values("line, predicate, arity, args, refused", [(FACT_LINES[0], "p", 2, "atom:a|integer:1", "no"), (FACT_LINES[1], "p", 2, "atom:a|atom:Tina", "no"), (FACT_LINES[5], None, None, None, "yes"), (FACT_LINES[6], None, None, None, "yes"), (FACT_LINES[7], "q", 2, 'string:x, "y"|year_month:1951-02', "no")])
        + ")",
    ),
    "written_and_loaded": (written_and_loaded, "SELECT o_orderkey O, o_custkey C, o_orderstatus S, o_totalprice P, strftime(o_orderdate, '%Y-%m-%d') D, o_orderpriority R FROM orders"),
    "stored_and_opened": (stored_and_opened, "SELECT CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM nation UNION ALL SELECT 99, 'NOWHERE', 2"),
    "mixed_store": (mixed_store, "SELECT event_id E, 'decimal' V_type, CASE WHEN contains(CAST(value AS VARCHAR), '.') THEN rtrim(rtrim(CAST(value AS VARCHAR), '0'), '.') ELSE CAST(value AS VARCHAR) END V FROM events WHERE value >= 90"),
    "stored_manifest": (
        stored_manifest,
        "WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', 2) "
        "SELECT 0 AS position, 'integer' AS type, count(*) AS count, count(DISTINCT n_nationkey) AS distinct_count, CAST(min(n_nationkey) AS VARCHAR) AS min, CAST(max(n_nationkey) AS VARCHAR) AS max FROM n "
        "UNION ALL SELECT 1, 'string', count(*), count(DISTINCT n_name), NULL, NULL FROM n UNION ALL SELECT 2, 'integer', count(*), count(DISTINCT n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM n",
    ),
    "stored_signatures": (
        stored_signatures,
        "SELECT 'orders' AS name, 6 AS arity, count(*) AS count, least(2, count(*)) AS examples FROM orders UNION ALL SELECT 'customer_segment', 2, count(*), least(2, count(*)) FROM customer",
    ),
    "cleared": (cleared, "SELECT 23 AS had, 0 AS has, 0 AS answer"),
    "predicate_list": (predicate_list, _values("name, arity", [(p.split()[0], int(p.split()[1])) for p in _PREDICATES.split(",")])),
    "predicate_samples": (
        predicate_samples,
        "SELECT * FROM (SELECT 'nation' AS name, CAST(3 AS BIGINT) AS sample_count, n_name AS value FROM nation ORDER BY sha256('nation/3|integer:' || n_nationkey || '|string:' || n_name || '|integer:' || n_regionkey) LIMIT 3) "
        "UNION ALL SELECT * FROM (SELECT 'region', CAST(3 AS BIGINT), r_name FROM region ORDER BY sha256('region/2|integer:' || r_regionkey || '|string:' || r_name) LIMIT 3)",
    ),
    "signatures": (
        signatures,
        "SELECT name, count, CAST(position AS INTEGER) AS position, types FROM (SELECT 'nation' AS name, count(*) AS count FROM nation) x, (VALUES (0, 'integer'), (1, 'string'), (2, 'integer')) t(position, types) "
        "UNION ALL SELECT 'customer_segment', (SELECT count(*) FROM customer), position, types FROM (VALUES (0, 'integer'), (1, 'string')) t(position, types)",
    ),
    "dumped_facts": (dumped_facts, "SELECT CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM nation"),
    "limited_facts": (limited_facts, "SELECT CAST(least(17, count(*)) AS BIGINT) AS count, CAST(17 AS BIGINT) AS max_results FROM customer"),
    "paging": (
        paging,
        "WITH n AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING') SELECT 'customer_segment(C, \"BUILDING\")' AS query, greatest(0, least(7, n - 10)) AS count, n AS total, greatest(0, least(7, n - 10)) AS different FROM n "
        "UNION ALL SELECT 'customer_segment(C, \"BUILDING\")', least(5, n), n, least(5, n) FROM n UNION ALL SELECT 'customer_segment(C, \"BUILDING\"), customer_nation(C, N)', greatest(0, least(4, n - 3)), NULL, greatest(0, least(4, n - 3)) FROM n",
    ),
    "service_codes": (
        service_codes,
        _values("asked, outcome", [
            ("too long", "query_too_long"), ("action", "unknown_action"), ("language", "unknown_language"), ("offset", "invalid_offset"), ("limit", "invalid_limit"), ("comparison", "execution_error"), ("unbound", "execution_error"), ("valid", "true"),
            ("route /", "200"), ("route /nothing", "404"), ("route /query/person", "1"), ("post", "2"), ("post broken", "400"), ("busy", "429"),
        ]),
    ),
    "fingerprints": (fingerprints, "SELECT true AS same, true AS hexadecimal, true AS other_schema_differs"),
    "config_limits": (config_limits, _values("given, timeout, results", [("{}", 5, 1000), ("{'query_timeout': 2}", 2, 1000), ("{'max_results': 0}", None, None), ("{'max_results': 1.5}", None, None), ("{'max_results': 7}", 5, 7)])),
    "calendar_days": (calendar_days, "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS number FROM orders WHERE month(o_orderdate) = 2 AND day(o_orderdate) > 27"),
}
