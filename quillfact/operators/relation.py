"""Relations over variables: scan, join, filter, optional, either, not, result.

A relation is a DataFrame with one column a variable, under a name of its own
(variables differ by case, Spark's columns don't), and what is known statically
of each: kind, types, and whether it may be unbound (null).  Each operator is one
DataFrame operator with plain conditions, so that Catalyst pushes filters into
the scans, prunes columns and picks join strategies by size.

Comparisons that some rows can't answer (a date against a number, an unbound
variable) must fail the query if such a row reaches them.  Raising inside the
plan would fire for rows a pushed filter sees too early, or never if the column
is pruned.  So a comparison is a pair of pure expressions, the answer and the
error text; where an error is possible at all, the rows are first asked for one.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MIXED, OPS, Term, equal, lift, lifted, literal, ordered, sort_keys, sql_type
from ..functions.values import ORDERED, YEAR_AND_DAY, comparable, order_failure
from ..plans import ast as A
from ..plans.explain import Access
from ..sources.catalog import Catalog, Predicate

_ids = itertools.count()


class QueryError(RuntimeError):
    """A comparison that a row can't answer."""


@dataclass(frozen=True)
class Binding:
    column: str
    kind: str
    types: frozenset
    unbound: bool = False  # may be null
    near: tuple[str, str] | None = None  # columns of the nearest doubles and of the values in structs, if made for comparisons

    def term(self) -> Term:
        return Term(F.col(self.column), self.kind, self.types, near=self.near and (F.col(self.near[0]), F.col(self.near[1])["x"]))

    @property
    def columns(self) -> list[str]:
        return [self.column, *(self.near or ())]


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    vars: dict[str, Binding]

    def select(self, names) -> Relation:
        kept = {v: self.vars[v] for v in names}
        return Relation(self.df.select(*[c for b in kept.values() for c in b.columns]), kept)

    def fresh(self) -> Relation:
        """The same with new column names, to be joined with a relation it may share columns with."""
        named = {v: replace(b, column=f"v{next(_ids)}", near=None) for v, b in self.vars.items()}
        return Relation(self.df.select(*[F.col(self.vars[v].column).alias(b.column) for v, b in named.items()]), named)


# -- scan -----------------------------------------------------------------------------


def _in_range(t: Term, path: Access) -> Column:
    """Rows of a range access: types without order are left out; an ordered type
    that can't be compared with a bound is an error for the whole access."""
    keep = F.lit(True)
    for op, end in ((">", path.low), ("<", path.high)):
        if end is None:
            continue
        for x in sorted(t.types & ORDERED):
            if not comparable(x, end[0].type):
                hint = f" {YEAR_AND_DAY}" if {x, end[0].type} == {"year", "date"} else ""
                raise QueryError(order_failure(x, f"{end[0].type} {end[0].text}") + hint)
        open_types = t.types & ORDERED
        if not open_types:
            return F.lit(False)
        if t.kind == MIXED:
            lit = F.lit(end[0].order).cast("decimal(38,18)")
            keep = keep & t.col["t"].isin(*sorted(open_types)) & OPS[op + "=" * end[1]](t.col["o"], lit)
        else:
            keep = keep & ordered(t, op + "=" * end[1], literal(end[0]))[0]
    return keep


def _facts(p: Predicate, pattern: A.Pattern, path: Access | None) -> DataFrame:
    """The facts of a predicate that a pattern and its access path allow, columns as the predicate has them.

    A predicate of several parts reads only those that hold values of the types
    asked for, each by its own columns.
    """
    given = {i: t.value for i, t in enumerate(pattern.args) if isinstance(t, A.Lit)}
    if path is not None and path.kind == "equal":
        given.setdefault(path.position, path.value)
    ranged = path is not None and path.kind == "range"
    tests, bounds = [], []
    if ranged:
        tests.append(_in_range(p.term(path.position), path))
    if p.parts:
        fits = lambda q: all(v.type in q.types[i] for i, v in given.items()) and not (ranged and not q.types[path.position] & ORDERED)
        rows = None
        for q in filter(fits, p.parts):
            cols = [(F.col(f"a{i}") if q.kinds[i] == k else lift(q.term(i))).alias(f"a{i}") for i, k in enumerate(p.kinds)]
            part = _facts(q, pattern, path).select(*cols)
            rows = part if rows is None else rows.unionAll(part)
        if rows is None:
            return p.df.where(F.lit(False))
        return rows if p.apart else rows.distinct()
    for i, v in given.items():
        tests.append(equal(p.term(i), literal(v)))
        bounds += p.bounds(i, "=", v)
    if ranged:
        for op, end in ((">", path.low), ("<", path.high)):
            if end is not None:
                bounds += p.bounds(path.position, op + "=" * end[1], end[0])
    seen: dict[str, int] = {}
    for i, t in enumerate(pattern.args):
        if isinstance(t, A.Var):
            if t.name in seen:
                tests.append(equal(p.term(seen[t.name]), p.term(i)))
            seen.setdefault(t.name, i)
    df = p.within(bounds)
    for t in tests:
        df = df.where(t)
    return df


def scan(catalog: Catalog, pattern: A.Pattern, path: Access | None = None) -> Relation:
    """One row per matching fact; wildcards bind nothing and drop no duplicate."""
    p = catalog.get(pattern.predicate)
    if p is None or p.arity != len(pattern.args):
        variables = dict.fromkeys(t.name for t in pattern.args if isinstance(t, A.Var))
        named = {v: Binding(f"v{next(_ids)}", "atom", frozenset()) for v in variables}
        schema = ", ".join(f"{b.column} string" for b in named.values()) or "none string"
        return Relation(catalog.spark.createDataFrame([], schema), named)
    at: dict[str, int] = {}
    for i, t in enumerate(pattern.args):
        if isinstance(t, A.Var):
            at.setdefault(t.name, i)
    df = _facts(p, pattern, path)
    named = {v: Binding(f"v{next(_ids)}", p.kinds[i], p.types[i]) for v, i in at.items()}
    return Relation(df.select(*[F.col(f"a{i}").alias(named[v].column) for v, i in at.items()]), named)


# -- filters --------------------------------------------------------------------------


def _term(t, variables: dict[str, Binding]) -> Term | None:
    if isinstance(t, A.Lit):
        return literal(t.value)
    b = variables.get(t.name) if isinstance(t, A.Var) else None
    return None if b is None else b.term()


def comparison(clause, variables: dict[str, Binding]) -> tuple[Column, Column | None]:
    """(answer, error text or None where no row can have one) of a comparison."""
    tests = [(clause.left, clause.op, clause.right)] if isinstance(clause, A.Compare) else [(clause.value, ">=", clause.low), (clause.value, "<=", clause.high)]
    keep, wrong = F.lit(True), None
    for x, op, y in tests:
        errors = []
        for t in (x, y):
            if isinstance(t, A.Wild):
                errors.append(F.lit("Wildcard in comparison"))
            elif isinstance(t, A.Var) and t.name not in variables:
                errors.append(F.lit(f"Unbound variable in comparison: {t.name}"))
            elif isinstance(t, A.Var) and variables[t.name].unbound:
                errors.append(F.when(F.col(variables[t.name].column).isNull(), F.lit(f"Unbound variable in comparison: {t.name}")))
        a, b = _term(x, variables), _term(y, variables)
        if a is None or b is None:
            holds = F.lit(False)
        elif op in ("=", "!="):
            same = F.coalesce(equal(a, b), F.lit(False))
            holds = same if op == "=" else ~same
        else:
            holds, failure = ordered(a, op, b)
            holds = F.coalesce(holds, F.lit(False))
            errors += [] if failure is None else [failure]
        if errors:
            here = F.coalesce(*errors)
            wrong = here if wrong is None else F.coalesce(wrong, F.when(keep, here))
        keep = keep & holds
    return keep, wrong


def condition(clauses, variables: dict[str, Binding]) -> tuple[Column | None, Column | None]:
    """All comparisons in order: the first that is false hides the errors of later ones."""
    keep = wrong = None
    for c in clauses:
        k, w = comparison(c, variables)
        if w is not None:
            w = w if keep is None else F.when(keep, w)
            wrong = w if wrong is None else F.coalesce(wrong, w)
        keep = k if keep is None else keep & k
    return keep, wrong


def _ask(df: DataFrame, wrong: Column | None) -> None:
    """Fail if a row has an error."""
    if wrong is not None and (found := df.select(wrong.alias("e")).where("e IS NOT NULL").limit(1).collect()):
        raise QueryError(found[0]["e"])


def where(rel: Relation, clauses) -> Relation:
    keep, wrong = condition(clauses, rel.vars)
    _ask(rel.df, wrong)
    return rel if keep is None else Relation(rel.df.where(keep), rel.vars)


# -- joins ----------------------------------------------------------------------------


def _match(l: Binding, r: Binding) -> Column:
    """Join condition of a shared variable; an unbound side matches anything."""
    a, b = l.term(), r.term()
    if l.kind == r.kind == MIXED:
        same = (a.col["t"] == b.col["t"]) & (a.col["c"] == b.col["c"])
    elif not l.types & r.types:
        same = F.lit(False)
    else:
        same = equal(a, b)
    if l.unbound:
        same = F.col(l.column).isNull() | F.coalesce(same, F.lit(False))
    if r.unbound:
        same = F.col(r.column).isNull() | F.coalesce(same, F.lit(False))
    return same


def _on(left: Relation, right: Relation) -> Column | None:
    on = None
    for v in right.vars:
        if v in left.vars:
            m = _match(left.vars[v], right.vars[v])
            on = m if on is None else on & m
    return on


def _seen(clause) -> list[A.Var]:
    """The variables of a comparison."""
    terms = (clause.left, clause.right) if isinstance(clause, A.Compare) else (clause.value, clause.low, clause.high)
    return [t for t in terms if isinstance(t, A.Var)]


def _across(left: Relation, right: Relation, clauses) -> list:
    """The comparisons other than equality of a variable of the left side alone with one of the right side alone."""
    found = []
    for c in clauses:
        names = {t.name for t in _seen(c)}
        if names & left.vars.keys() - right.vars.keys() and names & right.vars.keys() - left.vars.keys() and getattr(c, "op", None) != "=":
            found.append(c)
    return found


def _with_near(rel: Relation, names) -> Relation:
    """The same with the nearest double of each decimal among the names, made once a row and not once a pair.

    A join reads all columns of its condition for each pair, and a decimal makes
    objects; out of a struct it is read only where it is asked for.
    """
    more = {v: replace(b, near=(f"v{next(_ids)}", f"v{next(_ids)}")) for v, b in rel.vars.items() if v in names and b.kind == "decimal" and b.near is None}
    made = [c for b in more.values() for c in (F.col(b.column).cast("double").alias(b.near[0]), F.struct(F.col(b.column).alias("x")).alias(b.near[1]))]
    return Relation(rel.df.select("*", *made), rel.vars | more)


def _plain(left: Relation, right: Relation) -> list[str]:
    """The shared variables whose match is equality of two native columns."""
    return [v for v in right.vars if v in left.vars and left.vars[v].kind == right.vars[v].kind != MIXED and not (left.vars[v].unbound or right.vars[v].unbound)]


def _told(left: Relation, right: Relation, clauses) -> tuple[Relation, str | None]:
    """The left side with a column that tells whether a row matches any of the right side.

    Of one comparison by order, the greatest or least value there tells it; there is no
    column (None) for other comparisons, nor where one can fail or a match is no plain equality.
    """
    shared, same = [v for v in right.vars if v in left.vars], _plain(left, right)
    if len(clauses) != 1 or getattr(clauses[0], "op", None) not in OPS or shared != same or condition(clauses, {**right.vars, **left.vars})[1] is not None:
        return left, None
    x, op, y = clauses[0].left, clauses[0].op, clauses[0].right
    if x.name not in left.vars:
        x, op, y = y, op.translate(str.maketrans("<>", "><")), x
    a, b = left.vars[x.name], right.vars[y.name]
    if MIXED in (a.kind, b.kind):
        return left, None
    best, flag, by = f"v{next(_ids)}", f"v{next(_ids)}", {v: f"v{next(_ids)}" for v in same}
    ends = right.df.groupBy(*[F.col(right.vars[v].column).alias(c) for v, c in by.items()]).agg((F.max if op[0] == "<" else F.min)(b.column).alias(best))
    df = left.df.join(ends, [F.col(left.vars[v].column) == F.col(c) for v, c in by.items()], "left") if same else left.df.crossJoin(ends)
    holds = F.coalesce(ordered(a.term(), op, Term(F.col(best), b.kind, b.types))[0], F.lit(False))
    return Relation(df.select(*left.df.columns, holds.alias(flag)), left.vars), flag


def _dealt(left: Relation, right: Relation, how: str, flag: str | None) -> tuple[Relation, Relation, Column, Column | None]:
    """Both sides dealt into cells, the condition that rows are of one cell, and that
    of a left join's rows to be kept, if not all are.

    Rows that are compared in pairs may be few megabytes with few values of the
    shared variables, which Spark would give to few tasks, or to one.  So each side
    is cut into slices by a hash of its rows, and each slice goes to a cell with every
    slice of the other side; a pair meets in one cell.  Where left rows without a match
    count and ``flag`` tells them, they go to one cell, and the others leave no row in
    cells without a match; else only the left side is cut, so that each row sees all it may match.
    Cells are merged, not broadcast, so a task holds no more than Spark's buffers.
    """
    spark = left.df.sparkSession
    cells = 2 * spark.sparkContext.defaultParallelism
    n, m = (math.isqrt(cells - 1) + 1,) * 2 if how == "inner" or flag else (cells, 1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    same, sides, keys = _plain(left, right), [], []
    for rel, own, other, cell in ((left, n, m, lambda i, j: i * m + j), (right, m, n, lambda i, j: j * m + i)):
        mine = F.pmod(F.xxhash64(*[b.column for b in rel.vars.values()]), F.lit(own)) if own > 1 else F.lit(0)
        copy, key = f"v{next(_ids)}", f"v{next(_ids)}"
        kept, to = [c for b in rel.vars.values() for c in b.columns], F.array(*map(F.lit, range(other)))
        if rel is left and flag:
            kept, to = [*kept, flag], F.when(F.col(flag), to).otherwise(F.array(F.lit(0)))
        df = rel.df.select(*kept, (F.explode(to) if other > 1 else F.lit(0)).alias(copy))
        df = df.select(*kept, cell(mine, F.col(copy)).cast("int").alias(key))
        sides.append(Relation(df.repartition(tasks, *[rel.vars[v].column for v in same], key), rel.vars))
        keys.append(F.col(key))
    return sides[0], replace(sides[1], df=sides[1].df.hint("merge")), keys[0] == keys[1], keys[1].isNotNull() | ~F.col(flag) if flag else None


def _joined(left: Relation, right: Relation, outer: bool) -> tuple[dict[str, list[Column]], dict[str, Binding]]:
    """Columns and bindings of a join's result."""
    cols, out = {}, {}
    for v in [*left.vars, *[v for v in right.vars if v not in left.vars]]:
        l, r = left.vars.get(v), right.vars.get(v)
        if l is None:
            cols[v], out[v] = F.col(r.column), replace(r, unbound=r.unbound or outer)
        elif r is None or not l.unbound:
            cols[v], out[v] = F.col(l.column), l
        else:
            kind = l.kind if l.kind == r.kind else MIXED
            a, b = (F.col(l.column), F.col(r.column)) if kind == l.kind == r.kind else (lift(l.term()), lift(r.term()))
            cols[v], out[v] = F.coalesce(a, b), Binding(l.column, kind, l.types | r.types, r.unbound or outer)
    named = {v: replace(b, column=f"v{next(_ids)}", near=b.near and (f"v{next(_ids)}", f"v{next(_ids)}")) for v, b in out.items()}
    return {v: [cols[v].alias(b.column), *[F.col(c).alias(n) for c, n in zip(out[v].near or (), b.near or ())]] for v, b in named.items()}, named


def join(left: Relation, right: Relation, clauses=(), how: str = "inner", later=()) -> Relation:
    """Inner, left or left_anti join on shared variables and the comparisons ``clauses``
    of the right side's group, which see both sides.  ``later`` are comparisons that an
    inner join's result is filtered by, which Catalyst makes part of the join."""
    right = right.fresh()
    on, whole = _on(left, right), None
    if across := _across(left, right, [*clauses, *later]):
        names = {t.name for c in across for t in _seen(c)}
        left, right = _with_near(left, names - right.vars.keys()), _with_near(right, names - left.vars.keys())
        left, flag = _told(left, right, clauses) if how == "left" else (left, None)
        left, right, here, whole = _dealt(left, right, how, flag)
        on = here if on is None else on & here
    both = {**right.vars, **left.vars}
    if clauses:
        # the comparisons see a shared variable as it is after the join
        both = {v: replace(b, unbound=b.unbound and right.vars.get(v, b).unbound) for v, b in both.items()}
        cols = {v: right.vars[v] for v in right.vars if v in left.vars and left.vars[v].unbound}
        both |= cols
        keep, wrong = condition(clauses, both)
        pairs = left.df.crossJoin(right.df) if on is None else left.df.join(right.df, on, "inner")
        _ask(pairs, wrong)
        on = keep if on is None else on & keep
    if how == "left_anti":
        return Relation(left.df.join(right.df, F.lit(True) if on is None else on, "left_anti"), left.vars).select(left.vars)
    if on is None and how == "inner":
        df = left.df.crossJoin(right.df)
    else:
        df = left.df.join(right.df, F.lit(True) if on is None else on, how)
    df = df if whole is None else df.where(whole)
    cols, named = _joined(left, right, how == "left")
    return Relation(df.select(*[c for cs in cols.values() for c in cs]), named)


def union(parts: list[Relation]) -> Relation:
    """Bag union; a variable that a part lacks is unbound there."""
    out: dict[str, Binding] = {}
    for v in dict.fromkeys(v for p in parts for v in p.vars):
        have = [p.vars.get(v) for p in parts]
        kinds = {b.kind for b in have if b}
        out[v] = Binding(f"v{next(_ids)}", kinds.pop() if len(kinds) == 1 else MIXED, frozenset().union(*(b.types for b in have if b)), any(b is None or b.unbound for b in have))
    dfs = []
    for p in parts:
        cols = []
        for v, o in out.items():
            b = p.vars.get(v)
            c = F.lit(None) if b is None else lift(b.term()) if o.kind != b.kind else F.col(b.column)
            cols.append(c.cast(sql_type(o.kind)).alias(o.column))
        dfs.append(p.df.select(*cols))
    df = dfs[0]
    for d in dfs[1:]:
        df = df.unionAll(d)
    return Relation(df, out)


# -- the result -----------------------------------------------------------------------


def _directed(b: Binding, down: bool) -> list[Column]:
    """Sort columns with nulls last both ways."""
    keys = sort_keys(b.term())
    return [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]


def arranged(rel: Relation, query: A.Query) -> Relation:
    """Sort, project, distinct, offset, limit, in this order."""
    wanted = [v for v in dict.fromkeys(query.projection) if v in rel.vars]
    order = [(rel.vars[v], down) for v, down in query.order if v in rel.vars]
    if query.distinct:
        kept = [rel.vars[v].column for v in wanted]
        hidden = [(b, d) for b, d in order if b.column not in kept]
        if not hidden:
            rel = Relation(rel.df.select(*kept).distinct(), {v: replace(rel.vars[v], near=None) for v in wanted})
        else:
            # a row stands for the first of its copies: the least sort key, by a map-side combined minimum
            rel, order = _first_of_each(rel, wanted, order)
    df = rel.df
    if order:
        df = df.orderBy(*[k for b, d in order for k in (_directed(b, d) if isinstance(b, Binding) else b)])
    df = df.select(*[c for v in wanted for c in rel.vars[v].columns])
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    return Relation(df, {v: rel.vars[v] for v in wanted})


def _first_of_each(rel: Relation, wanted: list[str], order: list) -> tuple[Relation, list]:
    """One row for each of the wanted ones, with its least sort key.

    One column is a minimum or maximum; several are told by a row number, which
    Spark limits to one row a group before the shuffle, so a group of any size
    leaves each task as one row.
    """
    kept = [rel.vars[v].column for v in wanted]
    keys = [(k, down) for b, down in order for k in sort_keys(b.term())]
    names = [f"k{i}" for i in range(len(keys))]
    df = rel.df.select(*kept, *[k.alias(n) for (k, _), n in zip(keys, names)])
    by = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, (_, down) in zip(names, keys)]
    if len(names) == 1:
        df = df.groupBy(*kept).agg((F.max if keys[0][1] else F.min)(names[0]).alias(names[0]))  # both pass over nulls, which come last
    else:
        df = df.withColumn("turn", F.row_number().over(Window.partitionBy(*kept).orderBy(*by))).where("turn = 1").drop("turn")
    return Relation(df, {v: replace(rel.vars[v], near=None) for v in wanted}), [([k], False) for k in by]


def named(rel: Relation, doubles: bool = False) -> DataFrame:
    """Columns under their variables' names; values of several types as (type, value),
    decimals as the nearest doubles if asked for."""
    cols = []
    for v, b in rel.vars.items():
        c = F.col(b.column)
        if doubles and b.kind == "decimal":
            c = c.cast("double") if b.near is None else F.col(b.near[0])
        if b.kind == MIXED:
            c = F.when(c.isNotNull(), F.struct(c["t"].alias("type"), c["c"].alias("value")))
        cols.append(c.alias(v))
    return rel.df.select(*cols)


def as_json(rel: Relation, keep_nulls: bool) -> DataFrame:
    """One JSON text a row: {"Var": {"type": …, "value": …}}; unbound variables null or left out."""
    cols = []
    for v, b in rel.vars.items():
        t = lifted(b.term()).col
        cols.append(F.when(t.isNotNull(), F.struct(t["t"].alias("type"), t["c"].alias("value"))).alias(v))
    if not cols:
        return rel.df.select(F.lit("{}").alias("value"))
    return rel.df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value"))
