"""The engine: queries over a catalog, and the service calls around them."""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from .operators import relation as R
from .plans import ast as A
from .plans import explain as X
from .plans import parse as P
from .plans.environment import LANGUAGE_VERSION, fingerprint
from .plans.lower import lower
from .plans.validate import InvalidQuery, Problem, check_core, check_dsl
from .sources.catalog import Catalog
from .sources.facts import load_kind


@dataclass(frozen=True)
class Limits:
    """Limits of the service; ``Engine.query`` has none."""

    max_results: int = 1000
    query_timeout: float = 5.0
    max_intermediate_results: int = 10_000
    max_query_length: int = 20_000
    max_concurrent_queries: int = 20

    @classmethod
    def from_json(cls, given: dict) -> Limits:
        out = {}
        for f in fields(cls):
            v = given.get(f.name)
            if v is None:
                continue
            if isinstance(v, bool) or not isinstance(v, (int, float) if f.type == "float" else int):
                raise ValueError(f"'{f.name}' must be {'a number' if f.type == 'float' else 'an integer'}")
            if v <= 0:
                raise ValueError(f"'{f.name}' must be positive")
            out[f.name] = v
        return cls(**out)

    @classmethod
    def load(cls, path: str) -> Limits:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(json.load(f))


@dataclass(frozen=True)
class Outcome:
    """status: ok, invalid (body is the envelope) or failed (body has code and message)."""

    status: str
    body: dict

    @property
    def http_status(self) -> int:
        if self.status != "failed":
            return 200 if self.status == "ok" else 400
        return {"query_too_long": 413, "server_busy": 429}.get(self.body["code"], 400)


def looks_like_dsl(text: str) -> bool:
    words = text.split(maxsplit=1)
    return bool(words) and words[0].lower() == "find"


class Engine:
    def __init__(self, catalog: Catalog, limits: Limits | None = None):
        self.catalog, self.limits = catalog, limits or Limits()
        self._slots = threading.BoundedSemaphore(self.limits.max_concurrent_queries)

    @classmethod
    def of(cls, spark: SparkSession, **kw) -> Engine:
        return cls(Catalog(spark), **kw)

    # -- DataFrames -------------------------------------------------------------------

    def parse(self, text: str, language: str = "core") -> tuple[A.Query, list[Problem]]:
        """The checked query and warnings; ParseError or InvalidQuery otherwise."""
        if language == "dsl":
            query = P.dsl(text)
            return query, check_dsl(self.catalog, query)
        query = P.core(text)
        check_core(query)
        return query, []

    def relation(self, query: A.Query) -> R.Relation:
        return R.arranged(lower(self.catalog, query), query)

    def query(self, text: str, language: str | None = None, doubles: bool = False) -> DataFrame:
        """The result as a DataFrame, one column a variable, without limits; decimals as doubles if asked for.

        Comparisons that might fail on some row are tried at once; QueryError if one does.
        """
        query, _ = self.parse(text, language or ("dsl" if looks_like_dsl(text) else "core"))
        return R.named(self.relation(query), doubles)

    def explain(self, text: str, language: str | None = None) -> str:
        """Access paths, and Spark's plan below them."""
        query, _ = self.parse(text, language or ("dsl" if looks_like_dsl(text) else "core"))
        df = R.named(self.relation(query))
        return f"{X.as_text(query)}\n\n{df._jdf.queryExecution().toString()}"

    # -- service calls ----------------------------------------------------------------

    def _environment(self, language: str) -> dict:
        return {"language": language, "languageVersion": LANGUAGE_VERSION, "environmentFingerprint": fingerprint(self.catalog)}

    def _envelope(self, language: str, errors=(), warnings=(), **extra) -> dict:
        head = {"valid": not errors, "errors": [e.to_json() for e in errors], "warnings": [w.to_json() for w in warnings]}
        return head | self._environment(language) | extra

    def run_query(self, text: str, language: str = "core", action: str = "execute", offset: int | None = None, limit: int | None = None) -> Outcome:
        """execute, validate or explain a query of either language, under the limits."""
        if (size := len(text.encode())) > self.limits.max_query_length:
            return self._failed("query_too_long", f"The text has {size} bytes; {self.limits.max_query_length} are allowed.")
        if action not in ("execute", "validate", "explain"):
            return self._failed("unknown_action", f"{action!r} is none of the actions execute, validate, explain")
        if language not in ("core", "dsl"):
            return self._failed("unknown_language", f"{language!r} is none of the languages core, dsl")
        try:
            if language == "dsl":
                query, warnings = self.parse(text, "dsl")
            else:
                query, warnings = P.core(text), []
                if action != "explain":  # explaining only parses
                    check_core(query, offset, limit) if action == "execute" else check_core(query)
        except P.ParseError as e:
            return Outcome("invalid", self._envelope(language, [Problem("syntax_error", str(e))]))
        except InvalidQuery as e:
            return Outcome("invalid", self._envelope(language, e.problems))
        if action == "execute":
            return self._limited(lambda: self._execute(query, language, warnings, offset, limit))
        shown = {"projection": query.projection, "distinct": query.distinct}
        if action == "validate":
            shown = {"variables": query.variables} | (shown if language == "dsl" else {})
            return Outcome("ok", self._envelope(language, (), warnings, **shown))
        plan = {"normalizedCoreQuery": X.normalized(query), "plan": X.as_data(query), "planText": X.as_text(query)}
        return Outcome("ok", self._envelope(language, (), warnings, **shown, **plan))

    @staticmethod
    def _failed(code: str, message: str) -> Outcome:
        return Outcome("failed", {"code": code, "message": message})

    def _limited(self, work) -> Outcome:
        """Run within the time and the number of queries allowed; Spark jobs are cancelled by tag."""
        if not self._slots.acquire(blocking=False):
            return self._failed("server_busy", "All query slots are taken; ask again in a moment.")
        spark, tag = self.catalog.spark, f"query-{uuid.uuid4().hex}"

        def tagged():
            spark.addTag(tag)
            try:
                return work()
            finally:
                spark.removeTag(tag)

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(tagged).result(self.limits.query_timeout)
        except Late:
            spark.interruptTag(tag)
            return self._failed("timeout", f"No result within {self.limits.query_timeout:g} seconds. More constants or fewer patterns make a query cheaper.")
        except R.QueryError as e:
            return self._failed("execution_error", str(e))
        finally:
            self._slots.release()
            pool.shutdown(wait=False)

    def _execute(self, query: A.Query, language: str, warnings, offset, limit) -> Outcome:
        most = self.limits.max_results
        if language == "dsl":
            query = replace(query, limit=min(query.limit or most, most))
            rel = self.relation(query)
            rows = [json.loads(r["value"]) for r in R.as_json(rel, True).collect()]
            body = {"variables": query.projection, "results": [{v: r.get(v) for v in query.projection} for r in rows], "count": len(rows), "warnings": [w.to_json() for w in warnings]}
            return Outcome("ok", body | self._environment("dsl"))
        page = min(limit or most, most)
        bindings = lower(self.catalog, query)
        single = len([c for c in query.clauses if isinstance(c, A.Pattern)]) <= 1
        paged = R.arranged(bindings, replace(query, offset=offset or 0, limit=page))
        rows = [json.loads(r["value"]) for r in R.as_json(paged, False).collect()]
        body = {"variables": query.variables, "results": rows, "count": len(rows)}
        if single:  # of a join the total is not counted
            total = R.arranged(bindings, query).df.count()
            body |= {"total": total} | ({"offset": offset} if offset is not None else {}) | {"limit": page}
        return Outcome("ok", body | self._environment("core"))

    def list_predicates(self, samples: int | None = None) -> dict:
        """Names and arities; with 1 to 100 samples also facts."""
        samples = samples if samples is not None and 0 < samples <= 100 else None
        out = []
        for name in sorted(self.catalog.predicates):
            p = self.catalog.predicates[name]
            row = {"name": name, "arity": p.arity}
            if samples:
                facts = self._facts(name, samples)
                row |= {"samples": facts, "sample_count": len(facts)}
            out.append(row)
        return {"predicates": out} | ({"samples_per_predicate": samples} if samples else {})

    def describe(self, q: str | None = None, names: list[str] | None = None, examples: int = 3) -> dict:
        """Signatures with counts and examples, by part of the name or by names."""
        out = []
        for name in sorted(self.catalog.predicates):
            p = self.catalog.predicates[name]
            if (q and q.lower() not in name.lower()) or (names is not None and name not in names):
                continue
            arguments = [{"position": i, "types": sorted(t)} for i, t in enumerate(p.types)]
            out.append({"name": name, "arity": p.arity, "count": p.count(), "arguments": arguments, "examples": self._facts(name, examples)})
        return {"predicates": out, "environmentFingerprint": fingerprint(self.catalog), "languageVersion": LANGUAGE_VERSION}

    def _facts(self, name: str, n: int) -> list:
        p = self.catalog.predicates[name]
        rows = replace(p, df=p.sample(n)).structs().collect()
        return [[{"type": v["t"], "value": v["c"]} for v in r] for r in rows]

    def facts(self, name: str) -> dict:
        """Up to ``max_results`` facts of a predicate, none of an unknown one."""
        if name in self.catalog:
            p = self.catalog.predicates[name]
            rows = replace(p, df=p.df.limit(self.limits.max_results)).structs().collect()
        else:
            check_core(A.Query((A.Pattern(name, ()),)))
            rows = []
        found = [[{"type": v["t"], "value": v["c"]} for v in r] for r in rows]
        return {"predicate": name, "facts": found, "count": len(found), "limited": True, "max_results": self.limits.max_results}

    def run_file(self, path: str) -> list[tuple[str, Outcome]] | dict[str, str]:
        """Load a file of facts, or run a file of core queries, one a line."""
        if load_kind(path) == "facts":
            return self.catalog.load_file(path)
        with open(path, encoding="utf-8") as f:
            lines = [s.strip() for s in f if s.strip() and s.strip()[0] not in "%#"]
        return [(s, self.run_query(s)) for s in lines]
