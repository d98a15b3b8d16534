"""The eleven value types: literals, canonical text, equality, order.

A value is known by its type tag and canonical text; that pair is its identity,
and values of different types are never equal.  ``order`` is a decimal key for
the ordered types; which pairs of types can be ordered is in ``comparable``.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

TYPES = ("atom", "string", "lang_string", "integer", "decimal", "boolean", "year", "year_month", "date", "instant", "uri")
ORDERED = frozenset(("integer", "decimal", "year", "year_month", "date", "instant"))
INT64 = range(-(1 << 63), 1 << 63)

#: Pairs that compare at run time; each other ordered type only with itself.
_MIXED_ORDER = {frozenset(("integer", "decimal")), frozenset(("integer", "year"))}
_NUMBERS = frozenset(("integer", "decimal", "year"))


class ValueError_(ValueError):
    """A literal that is no value."""


@dataclass(frozen=True)
class Value:
    type: str
    text: str
    order: Decimal | None = None

    def __eq__(self, other):
        return isinstance(other, Value) and (self.type, self.text) == (other.type, other.text)

    def __hash__(self):
        return hash((self.type, self.text))

    def to_json(self) -> dict:
        return {"type": self.type, "value": self.text}


def comparable(a: str, b: str) -> bool:
    """Whether values of the two types have an order at run time."""
    return a in ORDERED and (a == b or frozenset((a, b)) in _MIXED_ORDER)


def comparable_statically(a: str, b: str) -> bool:
    """What validation accepts: it takes all three number-like types for comparable."""
    return (a in _NUMBERS and b in _NUMBERS) or (a == b and a in ORDERED)


def comparison_hint(a: str, b: str) -> str | None:
    pair = {a, b}
    if pair == {"date", "instant"}:
        return "A day has no order with a point in time: write both as dates or both as instants."
    for kind, name, example in (("date", "a date", "@1970-01-01"), ("instant", "an instant", "@1970-01-01T00:00:00Z"), ("year_month", "a year-month", "@1970-01")):
        if kind in pair and pair & _NUMBERS:
            return f"The other side is {name}; write one, e.g. {example}."
    return None


#: What a comparison of a year with a day is told besides.
YEAR_AND_DAY = "Write both as years, e.g. @1970, or both as days, e.g. @1970-01-01."


def order_failure(a: str, b: str) -> str:
    return f"{a} and {b} have no common order."


# -- calendar: proleptic Gregorian, any year ------------------------------------------

_CYCLE_DAYS, _EPOCH = 146_097, dt.date(1970, 1, 1).toordinal()


def epoch_day(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01; ValueError for no such day."""
    cycles, rest = divmod(y - 1, 400)
    return dt.date(rest + 1, m, d).toordinal() + cycles * _CYCLE_DAYS - _EPOCH


def civil(day: int) -> tuple[int, int, int]:
    cycles, rest = divmod(day + _EPOCH - 1, _CYCLE_DAYS)
    d = dt.date.fromordinal(rest + 1)
    return d.year + 400 * cycles, d.month, d.day


# -- constructors ---------------------------------------------------------------------


def atom(s: str) -> Value:
    return Value("atom", s)


def string(s: str) -> Value:
    return Value("string", s)


def lang_string(s: str, tag: str) -> Value:
    first, *rest = tag.split("-")
    if not re.fullmatch("[A-Za-z]{2,8}", first) or not all(re.fullmatch("[A-Za-z0-9]{1,8}", t) for t in rest):
        raise ValueError_(f"Invalid language tag: {tag}")
    return Value("lang_string", f"{s}@{tag}")


def uri(s: str) -> Value:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*:[^ \t\n<>]+", s):
        raise ValueError_(f"Malformed URI: {s}")
    return Value("uri", s)


def boolean(b: bool) -> Value:
    return Value("boolean", "true" if b else "false")


def integer(n: int) -> Value:
    if n not in INT64:
        raise ValueError_(f"Integer literal out of range: {n}")
    return Value("integer", str(n), Decimal(n))


def decimal(text: str) -> Value:
    sign, whole, part = re.fullmatch(r"(-?)(\d*)\.?(\d*)", text).groups()
    if int(f"{sign}{whole}{part}" or 0) not in INT64:
        raise ValueError_(f"Decimal literal out of range: {text}")
    part = part.rstrip("0")
    whole = whole.lstrip("0") or "0"
    plain = f"{whole}.{part}" if part else whole
    return Value("decimal", plain if plain == "0" else sign + plain, Decimal(sign + plain))


def year(y: int) -> Value:
    return Value("year", str(y), Decimal(y))


def year_month(y: int, m: int) -> Value:
    if not 1 <= m <= 12:
        raise ValueError_(f"Invalid year-month: {y:04d}-{m:02d}")
    return Value("year_month", f"{y:04d}-{m:02d}", Decimal(y * 100 + m))


def date(y: int, m: int, d: int) -> Value:
    try:
        day = epoch_day(y, m, d)
    except ValueError:
        raise ValueError_(f"Invalid date: {y:04d}-{m:02d}-{d:02d}") from None
    return Value("date", f"{y:04d}-{m:02d}-{d:02d}", Decimal(day))


def instant(seconds: int, nanos: int = 0) -> Value:
    day, rest = divmod(seconds, 86_400)
    y, m, d = civil(day)
    part = f".{nanos:09d}".rstrip("0") if nanos else ""
    text = f"{y:04d}-{m:02d}-{d:02d}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}{part}Z"
    return Value("instant", text, Decimal(seconds) + Decimal(nanos).scaleb(-9))


# -- temporal literals (what follows @) -----------------------------------------------

_YEAR = re.compile(r"-?\d+")
_MONTH = re.compile(r"(-?\d+)-(\d\d)")
_DATE = re.compile(r"(-?\d+)-(\d\d)-(\d\d)")
_TIME = re.compile(r"(\d\d):(\d\d):(\d\d)(?:\.(\d*))?(Z|[+-]\d\d:\d\d)")


def temporal(raw: str) -> Value:
    """The value of ``@raw``: an instant if it holds a T, else told by its dashes."""
    if "T" in raw:
        return _instant(raw)
    kind = raw.removeprefix("-").count("-")
    if kind == 0:
        if _YEAR.fullmatch(raw):
            return year(int(raw))
        raise ValueError_(f"Invalid year literal: {raw}")
    if kind == 1:
        if m := _MONTH.fullmatch(raw):
            return year_month(int(m[1]), int(m[2]))
        raise ValueError_(f"Invalid year-month literal: {raw}")
    if kind == 2:
        if m := _DATE.fullmatch(raw):
            return date(*map(int, m.groups()))
        raise ValueError_(f"Invalid date literal: {raw}")
    raise ValueError_(f"Invalid temporal literal: @{raw}")


def _instant(raw: str) -> Value:
    day, _, clock = raw.partition("T")
    d, t = _DATE.fullmatch(day), _TIME.fullmatch(clock)
    if not t and not re.search(r"Z$|[+-]", clock):
        raise ValueError_(f"Invalid instant literal (missing zone designator, use Z or +HH:MM): {raw}")
    if not d or not t:
        raise ValueError_(f"Invalid instant literal: {raw}")
    hour, minute, second = int(t[1]), int(t[2]), int(t[3])
    zone = t[5]
    away = 0 if zone == "Z" else int(zone[1:3]) * 60 + int(zone[4:6])
    if hour > 23 or minute > 59 or second > 60:  # a leap second runs into the next minute
        raise ValueError_(f"Invalid instant literal: {raw}")
    if zone != "Z" and (int(zone[1:3]) > 23 or int(zone[4:6]) > 59):
        raise ValueError_(f"Invalid instant literal (bad zone designator): {raw}")
    try:
        days = epoch_day(*map(int, d.groups()))
    except ValueError:
        raise ValueError_(f"Invalid instant literal: {raw}") from None
    seconds = days * 86_400 + hour * 3600 + minute * 60 + second - (-away if zone[0] == "-" else away) * 60
    return instant(seconds, int((t[4] or "")[:9].ljust(9, "0")))


def from_canonical(kind: str, text: str) -> Value:
    """The value of a type tag and a canonical text."""
    if kind == "lang_string":
        return lang_string(*text.rsplit("@", 1)) if "@" in text else lang_string(text, "")
    if kind in ("atom", "string"):
        return Value(kind, text)
    if kind == "uri":
        return uri(text)
    if kind == "integer":
        return integer(int(text))
    if kind == "decimal":
        return decimal(text)
    if kind == "boolean":
        if text not in ("true", "false"):
            raise ValueError_(f"Invalid boolean: {text}")
        return boolean(text == "true")
    if kind in ("year", "year_month", "date", "instant"):
        got = temporal(text)
        if got.type == kind:
            return got
    raise ValueError_(f"Not a {kind}: {text}")
