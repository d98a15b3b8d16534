"""Columns of typed values.

A column holds values of one type natively (``kind`` is its tag), or of any type
as a struct of tag, canonical text and order key (``kind`` is ``mixed``).
Everything here is a Catalyst expression; literals fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ORDERED, TYPES, YEAR_AND_DAY, Value, comparable

MIXED = "mixed"
STRUCT = "struct<t:string,c:string,o:decimal(38,18)>"
NATIVE = {
    "atom": "string", "string": "string", "lang_string": "string", "uri": "string", "integer": "bigint", "decimal": "decimal(38,18)",
    "boolean": "boolean", "year": "int", "year_month": "int", "date": "date", "instant": "timestamp",
}
MICRO = Decimal("0.000001")
#: Days and microseconds that Spark's date and timestamp show with a four-digit year.
DAYS, MICROS = (-719_162, 2_932_896), (-62_135_596_800_000_000, 253_402_300_799_999_999)


def sql_type(kind: str) -> str:
    return STRUCT if kind == MIXED else NATIVE[kind]


@dataclass(frozen=True)
class Term:
    """A column, its kind, and the types its values may have."""

    col: Column
    kind: str
    types: frozenset
    value: Value | None = None  # of a literal
    near: tuple[Column, Column] | None = None  # the nearest doubles of decimals and the decimals in a struct, made before


def native_literal(v: Value) -> Column | None:
    """The value as a native column, None where Spark's type can't hold it."""
    if v.type in ("atom", "string", "lang_string", "uri"):
        return F.lit(v.text)
    if v.type == "boolean":
        return F.lit(v.text == "true")
    n = v.order
    if v.type == "integer":
        return F.lit(int(n)).cast("bigint")
    if v.type == "decimal":
        return F.lit(n).cast("decimal(38,18)") if -n.as_tuple().exponent <= 18 else None
    if v.type in ("year", "year_month"):
        return F.lit(int(n)).cast("int") if abs(n) < 1 << 31 else None
    if v.type == "date":
        return F.date_from_unix_date(F.lit(int(n))) if DAYS[0] <= n <= DAYS[1] else None
    micros = n * 1_000_000
    return F.timestamp_micros(F.lit(int(micros)).cast("bigint")) if micros == int(micros) and MICROS[0] <= micros <= MICROS[1] else None


def literal(v: Value) -> Term:
    got = native_literal(v)
    if got is not None:
        return Term(got, v.type, frozenset((v.type,)), v)
    o = F.lit(v.order) if v.order is not None else F.lit(None)
    return Term(F.struct(F.lit(v.type).alias("t"), F.lit(v.text).alias("c"), o.cast("decimal(38,18)").alias("o")), MIXED, frozenset((v.type,)), v)


def canonical(col: Column, kind: str) -> Column:
    """Canonical text."""
    if kind == MIXED:
        return col["c"]
    if kind in ("atom", "string", "lang_string", "uri"):
        return col
    if kind == "decimal":
        # of numbers from one up the text is plain in every mode; below, it may have an exponent
        size = F.abs(col)
        part = F.rtrim(F.substring_index((size + 1).cast("decimal(38,18)").cast("string"), ".", -1), F.lit("0"))
        return F.concat(F.when(col < 0, "-").otherwise(""), F.floor(size).cast("string"), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    if kind == "year_month":
        return F.format_string("%04d-%02d", F.floor(col / 100), F.pmod(col, F.lit(100)))
    if kind == "date":
        return F.date_format(col, "yyyy-MM-dd")
    if kind == "instant":
        whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", ""), F.lit("Z"))
    return col.cast("string")


def order_key(col: Column, kind: str) -> Column:
    """Order key as decimal(38,18), null for types without order."""
    if kind == MIXED:
        return col["o"]
    if kind not in ORDERED:
        return F.lit(None).cast("decimal(38,18)")
    if kind == "date":
        col = F.unix_date(col)
    if kind == "instant":
        return (F.unix_micros(col).cast("decimal(19,0)") * F.lit(MICRO).cast("decimal(6,6)")).cast("decimal(38,18)")
    return col.cast("decimal(38,18)")


def lift(t: Term) -> Column:
    """The term as a struct; null stays null."""
    if t.kind == MIXED:
        return t.col
    made = F.struct(F.lit(t.kind).alias("t"), canonical(t.col, t.kind).alias("c"), order_key(t.col, t.kind).alias("o"))
    return F.when(t.col.isNotNull(), made)


def lifted(t: Term) -> Term:
    return t if t.kind == MIXED else Term(lift(t), MIXED, t.types, t.value)


def equal(a: Term, b: Term) -> Column:
    """Equality of values: false across types, null if a side is null."""
    if a.kind == b.kind != MIXED:
        return a.col == b.col
    if not a.types & b.types:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    tag = lambda t: t.col["t"] if t.kind == MIXED else F.when(t.col.isNotNull(), F.lit(t.kind))
    return (tag(a) == tag(b)) & (canonical(a.col, a.kind) == canonical(b.col, b.kind))


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _failure(a: Term, ta: Column, b: Term, tb: Column) -> Column:
    """What a row says whose two values have no common order: their types and texts."""
    named = [F.concat_ws(" ", tag, canonical(t.col, t.kind)) for t, tag in ((a, ta), (b, tb))]
    year_and_day = ((ta == "year") & (tb == "date")) | ((ta == "date") & (tb == "year"))
    return F.concat(named[0], F.lit(" and "), named[1], F.lit(" have no common order."), F.when(year_and_day, F.lit(f" {YEAR_AND_DAY}")).otherwise(F.lit("")))


def ordered(a: Term, op: str, b: Term) -> tuple[Column, Column | None]:
    """(whether it holds, error text where the values can't be ordered; None if all can)."""
    pairs = [(x, y) for x in a.types for y in b.types]
    good = [p for p in pairs if comparable(*p)]
    tag = lambda t: t.col["t"] if t.kind == MIXED else F.lit(t.kind)
    ta, tb = tag(a), tag(b)
    if not good:
        return F.lit(False), _failure(a, ta, b, tb)
    if a.kind != MIXED and b.kind != MIXED:
        if {a.kind, b.kind} <= {"integer", "decimal"} and (a.kind != b.kind or a.near is not None and b.near is not None):
            exact = OPS[op](*[(t.near[1] if t.near else t.col).cast("decimal(38,18)") for t in (a, b)])
            if all(t.near is not None or t.kind == "integer" for t in (a, b)):
                # the nearest doubles are in the order of the numbers, or the same; comparing decimals makes objects
                x, y = (t.col.cast("double") if t.near is None else t.near[0] for t in (a, b))
                exact = OPS[op[0]](x, y) | ((x == y) & exact)
            return exact, None
        return OPS[op](a.col, b.col), None
    holds = OPS[op](order_key(a.col, a.kind), order_key(b.col, b.kind))
    if len(good) == len(pairs):
        return holds, None
    fits = F.lit(False)
    for x, y in sorted(good):
        fits = fits | ((ta == x) & (tb == y))
    return fits & holds, F.when(~fits, _failure(a, ta, b, tb))


def sort_keys(t: Term) -> list[Column]:
    """Ascending keys for sorting: native order of ordered types, else canonical text;
    values of several types by type family, then key."""
    if t.kind != MIXED:
        return [canonical(t.col, t.kind) if t.kind == "boolean" else t.col]
    family = F.lit(len(TYPES))
    for k, group in enumerate((("integer", "decimal", "year"), ("year_month",), ("date",), ("instant",))):
        family = F.when(t.col["t"].isin(*group), k).otherwise(family)
    return [F.when(t.col.isNotNull(), family), t.col["o"], t.col["c"]]


def from_struct(col: Column, kind: str) -> Column:
    """The native column of a struct column that holds one type."""
    if kind == MIXED:
        return col
    if kind in ("atom", "string", "lang_string", "uri"):
        return col["c"]
    if kind == "boolean":
        return col["c"] == "true"
    if kind == "date":
        return F.date_from_unix_date(col["o"].cast("int"))
    if kind == "instant":
        return F.timestamp_micros((col["o"] * 1_000_000).cast("bigint"))
    return col["o"].cast(NATIVE[kind])
