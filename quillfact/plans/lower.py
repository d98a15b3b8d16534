"""A checked query as a relation.

Patterns first, in order of score but each connected to those before it if any
is; then groups in source order, a ``not`` after every group that binds one of
its variables; then the comparisons of the same level, which see the final
bindings.  Groups are lowered to joins, never run row by row.
"""

from __future__ import annotations

from ..operators import relation as R
from ..sources.catalog import Catalog
from . import ast as A
from .explain import choose, limits, score


def _patterns(catalog: Catalog, clauses, outer: set[str]) -> R.Relation | None:
    """The inner join of the patterns of one clause list."""
    known = limits(clauses)
    left = sorted((c for c in clauses if isinstance(c, A.Pattern)), key=lambda c: -score(c, known))
    seen, rel, paths, bound = set(), None, {}, set(outer)
    for c in left:  # access paths follow the order of score alone
        paths[id(c)] = choose(c, bound, known)
        bound.update(A.own_names(c))
    tied = [set(A.own_names(f)) for f in A.filters(clauses)]
    while left:
        near = [c for c in left if seen & set(A.own_names(c))]
        # next best: joined by a comparison; else nothing but a shared constant connects it
        near = near or [c for c in left if any(t & seen and t & set(A.own_names(c)) for t in tied)]
        c = (near or left)[0]
        left = [x for x in left if x is not c]
        step = R.scan(catalog, c, paths[id(c)])
        rel = step if rel is None else R.join(rel, step, later=A.filters(clauses))
        seen |= set(A.own_names(c))
    return rel


def _ordered_groups(clauses) -> list:
    """Groups in source order, but a ``not`` after the last group that binds one of its variables."""
    groups = [c for c in clauses if A.is_group(c)]
    binders = [(k, set(A.names([g], negated=False))) for k, g in enumerate(groups) if not isinstance(g, A.Not_)]

    def place(k, g):
        if not isinstance(g, A.Not_):
            return k, 0
        return max([k, *[j for j, v in binders if v & set(A.names(g.body))]]), 1

    order = sorted(range(len(groups)), key=lambda k: (*place(k, groups[k]), k))
    return [groups[k] for k in order]


def _unit(catalog: Catalog) -> R.Relation:
    """One row without variables."""
    return R.Relation(catalog.spark.range(1).select(), {})


def _group(catalog: Catalog, body, outer: R.Relation | None) -> tuple[R.Relation | None, tuple]:
    """(relation of a group by itself, comparisons still to be made with the outer row)."""
    rel = _patterns(catalog, body, set(outer.vars) if outer else set())
    for g in _ordered_groups(body):
        rel = _apply(catalog, g, rel)
    tests = tuple(A.filters(body))
    if rel is None or outer is None:
        return (rel, tests) if rel is None or not tests else (R.where(rel, tests), ())
    inside = [f for f in tests if set(A.own_names(f)) <= set(rel.vars)]
    if len(inside) == len(tests) and R.condition(tests, rel.vars)[1] is None:
        return R.where(rel, tests), ()  # all its own, and none can fail: filter before the join
    return rel, tests


def _apply(catalog: Catalog, group, outer: R.Relation | None) -> R.Relation | None:
    if isinstance(group, A.Either):
        parts = []
        for body in group.branches:
            rel, tests = _group(catalog, body, outer)
            if rel is None:
                parts.append(R.where(outer or _unit(catalog), tests))
            elif outer is None:
                parts.append(R.where(rel, tests))
            else:
                parts.append(R.join(outer, rel, tests))
        return R.union(parts)
    rel, tests = _group(catalog, group.body, outer)
    base = outer or _unit(catalog)
    if isinstance(group, A.Optional_):
        # without patterns it binds nothing and keeps every row
        if rel is None:
            R.where(base, tests)
            return outer
        return R.join(base, rel, tests, "left")
    if rel is None:  # an empty ``not`` holds for no row; one of comparisons alone for the rows they refuse
        keep, wrong = R.condition(tests, base.vars)
        R._ask(base.df, wrong)
        return R.Relation(base.df.where(~keep if keep is not None else R.F.lit(False)), base.vars)
    return R.join(base, rel, tests, "left_anti")


def lower(catalog: Catalog, query: A.Query) -> R.Relation:
    """All bindings of the query, before sorting and projection."""
    rel = _patterns(catalog, query.clauses, set())
    for g in _ordered_groups(query.clauses):
        rel = _apply(catalog, g, rel)
    return R.where(rel or _unit(catalog), A.filters(query.clauses))
