"""Extension, not part of the query languages: standing queries over a streaming predicate.

A predicate may be registered from a streaming DataFrame; a query then joins it
with stored predicates, and new facts give new rows.  Spark allows inner joins,
filters, ``either``, and ``optional`` or ``not`` of stored predicates; ordering,
limits and distinct need a bound (a watermark) and are refused here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..operators.relation import named
from ..plans.lower import lower


def standing(engine: Engine, text: str, language: str = "core") -> DataFrame:
    """The streaming result of a query over a catalog with a streaming predicate."""
    query, _ = engine.parse(text, language)
    if query.order or query.limit is not None or query.offset or query.distinct:
        raise ValueError("a standing query has no order, limit, offset or distinct")
    rel = lower(engine.catalog, query)
    return named(rel.select([v for v in query.projection if v in rel.vars]))
