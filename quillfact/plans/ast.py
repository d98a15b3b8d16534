"""Query trees of both languages."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.values import Value


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Wild:
    def __str__(self):
        return "_"


@dataclass(frozen=True)
class Lit:
    value: Value

    def __str__(self):
        return self.value.text


@dataclass(frozen=True)
class At:
    """Where a clause stands in the text; no part of its identity."""

    line: int | None = None
    column: int | None = None


@dataclass(frozen=True)
class Pattern:
    predicate: str
    args: tuple
    at: At = field(default=At(), compare=False)

    def __str__(self):
        return f"{self.predicate}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: object
    at: At = field(default=At(), compare=False)

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Between:
    value: object
    low: object
    high: object
    at: At = field(default=At(), compare=False)

    def __str__(self):
        return f"{self.value} between {self.low} and {self.high}"


def _inner(clauses) -> str:
    return ", ".join(map(str, clauses))


@dataclass(frozen=True)
class Optional_:
    body: tuple

    def __str__(self):
        return f"optional {{ {_inner(self.body)} }}"


@dataclass(frozen=True)
class Either:
    branches: tuple

    def __str__(self):
        return "either " + " or ".join(f"{{ {_inner(b)} }}" for b in self.branches)


@dataclass(frozen=True)
class Not_:
    body: tuple

    def __str__(self):
        return f"not {{ {_inner(self.body)} }}"


FILTERS = (Compare, Between)


@dataclass(frozen=True)
class Query:
    """``find`` None: all variables in alphabetical order."""

    clauses: tuple
    find: tuple | None = None
    distinct: bool = False
    order: tuple = ()  # (variable, descending)
    limit: int | None = None
    offset: int | None = None

    @property
    def variables(self) -> list[str]:
        return sorted(set(names(self.clauses)))

    @property
    def projection(self) -> list[str]:
        return list(self.find) if self.find is not None else self.variables


def terms(clause) -> tuple:
    if isinstance(clause, Pattern):
        return clause.args
    if isinstance(clause, Compare):
        return clause.left, clause.right
    return clause.value, clause.low, clause.high


def own_names(clause) -> list[str]:
    return [t.name for t in terms(clause) if isinstance(t, Var)]


def bodies(clause) -> tuple:
    """The clause lists nested in a group."""
    return clause.branches if isinstance(clause, Either) else (clause.body,)


def is_group(clause) -> bool:
    return isinstance(clause, (Optional_, Either, Not_))


def names(clauses, negated: bool = True) -> list[str]:
    """All variables, in order of mention; without those in ``not`` if asked."""
    out = []
    for c in clauses:
        if not is_group(c):
            out += own_names(c)
        elif negated or not isinstance(c, Not_):
            for b in bodies(c):
                out += names(b, negated)
    return out


def patterns(clauses) -> list[Pattern]:
    out = []
    for c in clauses:
        if isinstance(c, Pattern):
            out.append(c)
        elif is_group(c):
            out += [p for b in bodies(c) for p in patterns(b)]
    return out


def filters(clauses) -> list:
    return [c for c in clauses if isinstance(c, FILTERS)]
