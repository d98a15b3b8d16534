"""Queries over the relational test tables, one for each operator, with DuckDB SQL.

Tables become predicates once, here; each query is text of the core language or
of the ``find … where …`` language.  Decimals are shown as doubles, dates and
instants as text, and values of several types as a type and a value column, so
that other engines' results compare.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.catalog import Catalog

#: predicate -> (table, columns, value types where the column's type does not tell, whether rows repeat)
PREDICATES = {
    "region": ("region", ["r_regionkey", "r_name"], {}, False),
    "nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"], {}, False),
    "customer": ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], {}, False),
    "customer_nation": ("customer", ["c_custkey", "c_nationkey"], {}, False),
    "customer_segment": ("customer", ["c_custkey", "c_mktsegment"], {}, False),
    "supplier": ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], {}, False),
    "supplier_nation": ("supplier", ["s_suppkey", "s_nationkey"], {}, False),
    "part": ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], {}, False),
    "part_size": ("part", ["p_partkey", "p_size"], {}, False),
    "part_price": ("part", ["p_partkey", "p_retailprice"], {}, False),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"o_orderdate": "date"}, False),
    "order_customer": ("orders", ["o_orderkey", "o_custkey"], {}, False),
    "order_date": ("orders", ["o_orderkey", "o_orderdate"], {"o_orderdate": "date"}, False),
    "order_year": ("orders", ["o_orderkey", "o_orderdate"], {"o_orderdate": "year"}, False),
    "order_month": ("orders", ["o_orderkey", "o_orderdate"], {"o_orderdate": "year_month"}, False),
    "line_part": ("lineitem", ["l_orderkey", "l_partkey"], {}, True),
    "line_supplier": ("lineitem", ["l_orderkey", "l_suppkey"], {}, True),
    "line_ship": ("lineitem", ["l_orderkey", "l_partkey", "l_shipdate"], {"l_shipdate": "date"}, True),
    "line_flag": ("lineitem", ["l_orderkey", "l_returnflag"], {"l_returnflag": "atom"}, True),
    "event": ("events", ["event_id", "ts", "user_id", "event_type", "value"], {"event_type": "atom"}, False),
    "event_type": ("events", ["event_id", "event_type"], {"event_type": "atom"}, False),
    "event_value": ("events", ["event_id", "value"], {}, False),
}


#: predicates that hold the facts of others
UNIONS = {"measure": ["event_value", "event_type"]}


def catalog(spark: SparkSession, sf_dir: str, text: str | None = None) -> Catalog:
    """Predicates of the tables in a folder, those that a query text names or all;
    nothing is read yet but schemas."""
    out, tables = Catalog(spark), {}
    named = set(re.findall(r"\b([a-z0-9_]+)\(", text)) if text is not None else {*PREDICATES, *UNIONS}
    wanted = named.union(*(parts for u, parts in UNIONS.items() if u in named))
    for name, (table, columns, kinds, repeats) in PREDICATES.items():
        if name not in wanted:
            continue
        df = tables.get(table)
        if df is None:
            df = tables[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        out.register(name, df, columns, kinds, distinct=repeats, complete=True)  # these tables have no nulls
    for name in named & UNIONS.keys():
        out.union(name, UNIONS[name])
    return out


def shown(df: DataFrame) -> DataFrame:
    """Columns as types that any engine has."""
    cols = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("struct"):
            cols += [c["type"].alias(f"{f.name}_type"), c["value"].alias(f.name)]
        elif kind.startswith("decimal"):
            cols.append(c.cast("double").alias(f.name))
        elif kind == "date":
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif kind == "timestamp":
            cols.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


#: name -> (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "scan": ("nation(N, Name, R)", "SELECT CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM nation"),
    "literal_eq": ('customer(C, Name, N, _, "BUILDING")', "SELECT c_custkey C, c_name Name, CAST(c_nationkey AS BIGINT) N FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "wildcard_bag": ('orders(_, C, "F", _, _, _)', "SELECT o_custkey C FROM orders WHERE o_orderstatus = 'F'"),
    "repeated_var": ("supplier_nation(X, X)", "SELECT s_suppkey X FROM supplier WHERE s_suppkey = s_nationkey"),
    "cmp_eq": ("nation(N, Name, R), R = 2", "SELECT CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM nation WHERE n_regionkey = 2"),
    "cmp_ne": ("nation(N, Name, R), 2 != R", "SELECT CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM nation WHERE n_regionkey <> 2"),
    "cmp_lt": ("part_size(P, S), S < 10", "SELECT p_partkey P, CAST(p_size AS BIGINT) S FROM part WHERE p_size < 10"),
    "cmp_le": ("part_size(P, S), S <= 10", "SELECT p_partkey P, CAST(p_size AS BIGINT) S FROM part WHERE p_size <= 10"),
    "cmp_gt": ("part_size(P, S), S > 40", "SELECT p_partkey P, CAST(p_size AS BIGINT) S FROM part WHERE p_size > 40"),
    "cmp_ge": ("part_size(P, S), 40 <= S", "SELECT p_partkey P, CAST(p_size AS BIGINT) S FROM part WHERE p_size >= 40"),
    "cmp_literals": ("region(R, N), 1 < 2.5", "SELECT CAST(r_regionkey AS BIGINT) R, r_name N FROM region"),
    "conjunction": ("part(P, _, B, _, S, V), S >= 10, S < 20, V > 950, B != \"Brand#11\"", "SELECT p_partkey P, p_brand B, CAST(p_size AS BIGINT) S, p_retailprice V FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950 AND p_brand <> 'Brand#11'"),
    "between_date": ("order_date(O, D), D between @1995-03-01 and @1995-08-31", "SELECT o_orderkey O, strftime(o_orderdate, '%Y-%m-%d') D FROM orders WHERE o_orderdate BETWEEN DATE '1995-03-01' AND DATE '1995-08-31'"),
    "range_instant": ("event(E, T, U, _, _), T >= @2024-01-05T00:00:00Z, T < @2024-01-09T12:00:00+02:00", "SELECT event_id E, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') T, user_id U FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 10:00:00'"),
    "year_int_promotion": ("order_year(O, Y), Y >= 1996", "SELECT o_orderkey O, CAST(year(o_orderdate) AS INTEGER) Y FROM orders WHERE year(o_orderdate) >= 1996"),
    "year_equals_integer": ("order_year(O, Y), Y = 1996", "SELECT o_orderkey O, CAST(year(o_orderdate) AS INTEGER) Y FROM orders WHERE FALSE"),
    "year_month_range": ("order_month(O, M), M between @1996-11 and @1997-02", "SELECT o_orderkey O, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) M FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199611 AND 199702"),
    "int_decimal_promotion": ("part_price(P, V), V >= 950", "SELECT p_partkey P, p_retailprice V FROM part WHERE p_retailprice >= 950"),
    "decimal_equals_integer": ("part_size(P, S), S != 5.0, S <= 5.0", "SELECT p_partkey P, CAST(p_size AS BIGINT) S FROM part WHERE p_size <= 5"),
    "join_equi": ("customer_nation(C, N), nation(N, Name, R)", "SELECT c_custkey C, CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_multikey": (
        "line_part(O, P), line_ship(O, P, D), D >= @1998-01-01",
        "SELECT DISTINCT l_orderkey O, l_partkey P, strftime(l_shipdate, '%Y-%m-%d') D FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'",
    ),
    "self_join": (
        "supplier_nation(S1, N), supplier_nation(S2, N), S1 < S2",
        "SELECT CAST(a.s_nationkey AS BIGINT) N, a.s_suppkey S1, b.s_suppkey S2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    ),
    "join_chain4": (
        'region(R, "ASIA"), nation(N, Name, R), customer_nation(C, N), order_customer(O, C)',
        "SELECT CAST(r_regionkey AS BIGINT) R, CAST(n_nationkey AS BIGINT) N, n_name Name, c_custkey C, o_orderkey O FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA'",
    ),
    "theta_var_var": (
        "customer(C, _, N, A, _), supplier(S, _, N, B), A < B",
        "SELECT c_acctbal A, s_acctbal B, c_custkey C, CAST(c_nationkey AS BIGINT) N, s_suppkey S FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal",
    ),
    "theta_join": ("region(R1, A), region(R2, B), R1 < R2", "SELECT a.r_name A, b.r_name B, CAST(a.r_regionkey AS BIGINT) R1, CAST(b.r_regionkey AS BIGINT) R2 FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "const_join": ("nation(A, _, 2), nation(B, _, 2)", "SELECT CAST(a.n_nationkey AS BIGINT) A, CAST(b.n_nationkey AS BIGINT) B FROM nation a CROSS JOIN nation b WHERE a.n_regionkey = 2 AND b.n_regionkey = 2"),
    "ground_pattern": ("region(2, Name), nation(_, _, 2)", "SELECT r_name Name FROM region CROSS JOIN nation WHERE r_regionkey = 2 AND n_regionkey = 2"),
    "mixed_type_eq": ("measure(E, V), V = click", "SELECT event_id E, 'atom' V_type, event_type V FROM events WHERE event_type = 'click'"),
    "mixed_type_range": ("measure(E, V), V >= 90", "SELECT event_id E, 'decimal' V_type, CASE WHEN contains(CAST(value AS VARCHAR), '.') THEN rtrim(rtrim(CAST(value AS VARCHAR), '0'), '.') ELSE CAST(value AS VARCHAR) END V FROM events WHERE value >= 90"),
    "mixed_type_join": (
        "measure(E, V), event_type(E, V)",
        "SELECT event_id E, 'atom' V_type, event_type V FROM events",
    ),
    "core_alphabetical": ("nation(Z, M, A)", "SELECT CAST(n_regionkey AS BIGINT) A, n_name M, CAST(n_nationkey AS BIGINT) Z FROM nation"),
    "project_bag": ("find R\nwhere\n  nation(N, Name, R)", "SELECT CAST(n_regionkey AS BIGINT) R FROM nation"),
    "distinct": ("find distinct S, N\nwhere\n  customer(C, _, N, _, S)", "SELECT DISTINCT c_mktsegment S, CAST(c_nationkey AS BIGINT) N FROM customer"),
    "distinct_order_hidden": (
        "find distinct N\nwhere\n  customer(C, _, N, B, _)\norder by B descending, C\nlimit 5",
        "SELECT N FROM (SELECT CAST(c_nationkey AS BIGINT) N, max(c_acctbal) b FROM customer GROUP BY 1 ORDER BY b DESC LIMIT 5)",
    ),
    "order_limit": ("find P, S\nwhere\n  part_size(P, S)\norder by S desc, P asc\nlimit 25", "SELECT p_partkey P, CAST(p_size AS BIGINT) S FROM part ORDER BY p_size DESC, p_partkey LIMIT 25"),
    "order_text_limit": ("find S, Name\nwhere\n  customer(C, Name, _, _, S)\norder by S, Name desc\nlimit 25", "SELECT c_mktsegment S, c_name Name FROM customer ORDER BY c_mktsegment, c_name DESC LIMIT 25"),
    "limit_offset": ("find O, D\nwhere\n  order_date(O, D)\norder by D, O\noffset 100\nlimit 40", "SELECT o_orderkey O, strftime(o_orderdate, '%Y-%m-%d') D FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 100"),
    "order_nulls_last": (
        'find C, O\nwhere\n  customer_segment(C, "BUILDING")\n  optional\n    orders(O, C, "P", _, _, _)\norder by O descending, C',
        "SELECT c_custkey C, o_orderkey O FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING' ORDER BY O DESC NULLS LAST, C",
    ),
    "optional_one": (
        "find C, O\nwhere\n  customer_nation(C, 7)\n  optional\n    order_customer(O, C)",
        "SELECT c_custkey C, o_orderkey O FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7",
    ),
    "optional_multi": (
        "find C, O, P\nwhere\n  customer_nation(C, 7)\n  optional\n    order_customer(O, C)\n    line_part(O, P)",
        "SELECT c_custkey C, x.O, x.P FROM customer LEFT JOIN (SELECT o_custkey k, o_orderkey O, P FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey P FROM lineitem) ON l_orderkey = o_orderkey) x ON k = c_custkey WHERE c_nationkey = 7",
    ),
    "optional_outer_filter": (
        "find S, C\nwhere\n  supplier(S, _, N, B)\n  optional\n    customer(C, _, N, A, _)\n    A > B",
        "SELECT s_suppkey S, c_custkey C FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal",
    ),
    "optional_shared": (
        "find N, S, C\nwhere\n  nation(N, _, 1)\n  optional\n    supplier(S, _, N, B)\n    B > 9000\n  optional\n    customer_nation(S, N)\n    customer(C, _, N, A, _)\n    A > 9990",
        "SELECT N, coalesce(a.S, x.S) S, x.C FROM (SELECT CAST(n_nationkey AS BIGINT) N, s_suppkey S FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE n_regionkey = 1) a LEFT JOIN (SELECT p.c_nationkey k, p.c_custkey S, q.c_custkey C FROM customer p JOIN customer q ON p.c_nationkey = q.c_nationkey AND q.c_acctbal > 9990) x ON k = N AND (a.S IS NULL OR a.S = x.S)",
    ),
    "not_anti": (
        "find C, Name\nwhere\n  customer(C, Name, N, _, _)\n  not\n    customer_nation(C, N)\n    nation(N, _, 2)",
        "SELECT c_custkey C, c_name Name FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2)",
    ),
    "not_correlated_filter": (
        'find R\nwhere\n  region(R, N)\n  R >= 0\n  not\n    nation(_, _, R)\n    R > 2',
        "SELECT CAST(r_regionkey AS BIGINT) R FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND r_regionkey > 2)",
    ),
    "either_union_bag": (
        'find C\nwhere\n  customer_nation(C, N)\n  either\n    customer_segment(C, "BUILDING")\n  or\n    nation(N, _, 2)',
        "SELECT c_custkey C FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2",
    ),
    "either_missing_vars": (
        "find N, S, C\nwhere\n  nation(N, _, 3)\n  either\n    supplier_nation(S, N)\n  or\n    customer_nation(C, N)",
        "SELECT CAST(n_nationkey AS BIGINT) N, s_suppkey S, CAST(NULL AS BIGINT) C FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 3 UNION ALL SELECT CAST(n_nationkey AS BIGINT), NULL, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 3",
    ),
    "either_types": (
        "find E, V\nwhere\n  event(E, _, 5, _, _)\n  either\n    event_value(E, V)\n  or\n    event_type(E, V)",
        "SELECT event_id E, 'decimal' V_type, CASE WHEN contains(CAST(value AS VARCHAR), '.') THEN rtrim(rtrim(CAST(value AS VARCHAR), '0'), '.') ELSE CAST(value AS VARCHAR) END V FROM events WHERE user_id = 5 UNION ALL SELECT event_id, 'atom', event_type FROM events WHERE user_id = 5",
    ),
    "groups_together": (
        "find distinct Name, O\nwhere\n  customer(C, Name, N, B, _)\n  B >= 0\n  nation(N, _, 0)\n  optional\n    order_customer(O, C)\n    order_year(O, @1996)\n  not\n    customer_segment(C, \"MACHINERY\")\norder by Name, O",
        "SELECT DISTINCT c_name Name, o_orderkey O FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = 1996 WHERE c_acctbal >= 0 AND n_regionkey = 0 AND c_mktsegment <> 'MACHINERY' ORDER BY Name, O NULLS LAST",
    ),
}


def _text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = TEXTS[name][0]
        return shown(Engine(catalog(spark, sf_dir, text)).query(text, doubles=True))

    return run


def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a predicate by position and type."""
    return catalog(spark, sf_dir, "nation(").manifest("nation")


def manifest_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir, "measure(").manifest("measure").select("position", "type", "count", "distinct_count")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty facts, those with the least ids."""
    return catalog(spark, sf_dir, "nation(").predicates["nation"].sample(20).select(F.col("a0").alias("N"), F.col("a1").alias("Name"), F.col("a2").alias("R"))


def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog(spark, sf_dir, "customer_segment(").predicates["customer_segment"]
    return p.with_ids().select(F.col("a0").alias("C"), F.col("a1").alias("S"), "fact_id")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as typed JSON, unbound variables null."""
    from .operators.relation import as_json

    engine = Engine(catalog(spark, sf_dir, "region(nation("))
    query, _ = engine.parse("find R, N\nwhere\n  region(R, N)\n  optional\n    nation(R, N, _)", "dsl")
    return as_json(engine.relation(query), True)


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "manifest_stats": (
        manifest_stats,
        "SELECT 0 AS position, 'integer' AS type, count(*) AS count, count(DISTINCT n_nationkey) AS distinct_count, CAST(min(n_nationkey) AS VARCHAR) AS min, CAST(max(n_nationkey) AS VARCHAR) AS max FROM nation "
        "UNION ALL SELECT 1, 'string', count(*), count(DISTINCT n_name), NULL, NULL FROM nation "
        "UNION ALL SELECT 2, 'integer', count(*), count(DISTINCT n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation",
    ),
    "manifest_mixed": (
        manifest_mixed,
        "SELECT 0 AS position, 'integer' AS type, 2 * count(*) AS count, count(DISTINCT event_id) AS distinct_count FROM events "
        "UNION ALL SELECT 1, 'decimal', count(*), count(DISTINCT value) FROM events UNION ALL SELECT 1, 'atom', count(*), count(DISTINCT event_type) FROM events",
    ),
    "samples": (
        samples,
        "SELECT CAST(n_nationkey AS BIGINT) N, n_name Name, CAST(n_regionkey AS BIGINT) R FROM nation ORDER BY sha256('nation/3|integer:' || n_nationkey || '|string:' || n_name || '|integer:' || n_regionkey) LIMIT 20",
    ),
    "fact_ids": (fact_ids, "SELECT c_custkey C, c_mktsegment S, sha256('customer_segment/2|integer:' || c_custkey || '|string:' || c_mktsegment) AS fact_id FROM customer"),
    "json_rows": (
        json_rows,
        """SELECT '{"R":{"type":"integer","value":"' || r_regionkey || '"},"N":{"type":"string","value":"' || r_name || '"}}' AS value FROM region""",
    ),
}

FLAGSHIP = """
find Name, Segment, Order, Date
where
  region(R, "ASIA")
  nation(N, Name, R)
  customer(C, _, N, Balance, Segment)
  Balance >= 0
  optional
    order_customer(Order, C)
    order_date(Order, Date)
    Date >= @1996-01-01
  not
    customer_segment(C, "MACHINERY")
order by Name ascending, Segment, Order
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join, optional, not and order in one query."""
    return shown(Engine(catalog(spark, sf_dir, FLAGSHIP)).query(FLAGSHIP))


FLAGSHIP_SQL = """
SELECT n_name AS Name, c_mktsegment AS Segment, o_orderkey AS "Order", strftime(o_orderdate, '%Y-%m-%d') AS Date
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= DATE '1996-01-01'
WHERE r_name = 'ASIA' AND c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | {n: _text_query(n) for n in TEXTS} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | {n: sql for n, (_, sql) in TEXTS.items()} | {n: sql for n, (_, sql) in OTHERS.items()}
