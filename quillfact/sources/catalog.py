"""Predicates: named relations of typed positions, their manifest, and the store."""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MIXED, NATIVE, Term, canonical, from_struct, lift, order_key, sql_type
from ..functions.values import ORDERED, Value
from . import facts as text

#: Spark type -> value type, unless told otherwise.
INFERRED = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "instant", "timestamp_ntz": "instant"}

MANIFEST = "position int, type string, count bigint, distinct_count bigint, min string, max string"
#: Facts of each predicate that a store keeps aside for listings, which show 100 at most.
KEPT_SAMPLES = 100


class CatalogError(ValueError):
    """Facts that make no predicate."""


@dataclass(frozen=True)
class Source:
    """Columns (name, Spark type) of a DataFrame and what they become as positions."""

    df: DataFrame
    columns: tuple[tuple[str, str], ...]
    positions: tuple[Column, ...]
    distinct: bool

    def facts(self, bounds=()) -> DataFrame:
        df = self.df
        for b in bounds:
            df = df.where(b)
        df = df.select(*self.positions)
        return df.distinct() if self.distinct else df


def _first_day(month: int) -> dt.date | None:
    """The first day of a month counted from year 0, None if Python has no such day."""
    return dt.date(month // 12, month % 12 + 1, 1) if 12 <= month < 120_000 else None


def _outer_bounds(column: str, source: str, kind: str, op: str, value: Value) -> list[Column]:
    col = F.col(f"`{column}`")
    if op == "=":
        return [b for o in (">=", "<=") for b in _outer_bounds(column, source, kind, o, value)] if value.type == kind else []
    if kind in ("year", "year_month") and source in ("date", "timestamp", "timestamp_ntz") and value.type in (kind, "integer"):
        if kind == "year":
            first, months = int(value.order) * 12, 12
        else:
            if value.type != kind:
                return []
            year, month = value.text.rsplit("-", 1)
            first, months = int(year) * 12 + int(month) - 1, 1
        day = _first_day(first + months * (op in ("<=", ">")))
        return [] if day is None else [col >= F.lit(day) if op in (">", ">=") else col < F.lit(day)]
    if kind == "decimal" and source == "double" and value.type in ("decimal", "integer"):
        # two steps out: the decimal of a double is its shortest text, within half a step of it
        x, way = float(value.order), -math.inf if op in (">", ">=") else math.inf
        x = math.nextafter(math.nextafter(x, way), way)
        return [col >= F.lit(x) if way < 0 else col <= F.lit(x)]
    return []


@dataclass(frozen=True)
class Known:
    """What a store holds about a predicate besides its facts: their number, the rows
    of the manifest, and a folder with the first ``KEPT_SAMPLES`` of them by fact id."""

    count: int
    manifest: tuple[tuple, ...]
    samples: str

    def to_json(self) -> dict:
        return {"count": self.count, "manifest": self.manifest, "samples": self.samples.rsplit("/", 1)[1]}


@dataclass(frozen=True)
class Predicate:
    """``df`` has columns a0, a1, …: distinct facts without nulls."""

    name: str
    df: DataFrame
    kinds: tuple[str, ...]
    types: tuple[frozenset, ...]
    home: str | None = None  # folder of a store that holds exactly these facts
    source: Source | None = None  # the columns that a registered DataFrame has for them
    parts: tuple[Predicate, ...] = ()  # the predicates whose facts these are, if they are those of several
    apart: bool = True  # no fact is in two parts
    known: Known | None = None  # of a store's predicate

    @property
    def arity(self) -> int:
        return len(self.kinds)

    def term(self, i: int) -> Term:
        return Term(F.col(f"a{i}"), self.kinds[i], self.types[i])

    def structs(self) -> DataFrame:
        """All positions as structs of tag, canonical text and order key."""
        return self.df.select(*[lift(self.term(i)).alias(f"a{i}") for i in range(self.arity)])

    def bounds(self, i: int, op: str, value: Value) -> list[Column]:
        """Conditions on the source's own column that every fact with ``a{i} op value`` meets.

        They add nothing to the result; unlike tests of a computed column they reach the scan.
        """
        return [] if self.source is None else _outer_bounds(*self.source.columns[i], self.kinds[i], op, value)

    def within(self, bounds: list[Column]) -> DataFrame:
        """The facts, less some that don't meet the bounds."""
        return self.df if self.source is None or not bounds else self.source.facts(bounds)

    def with_ids(self) -> DataFrame:
        """Facts with their id: a digest of name, arity and typed arguments."""
        parts = [F.lit(f"{self.name}/{self.arity}")] + [F.concat(F.lit("|"), s["t"], F.lit(":"), s["c"]) for s in (lift(self.term(i)) for i in range(self.arity))]
        return self.df.withColumn("fact_id", F.sha2(F.concat(*parts), 256))

    def count(self) -> int:
        """The number of facts; a store's predicate is not read for it."""
        return self.df.count() if self.known is None else self.known.count

    def sample(self, n: int) -> DataFrame:
        """n facts, the same ones each time; few of a store's predicate are read from those it keeps aside."""
        kept = self if self.known is None or n > KEPT_SAMPLES else replace(self, df=self.df.sparkSession.read.schema(_ddl(self.kinds)).parquet(self.known.samples))
        return kept.with_ids().orderBy("fact_id").limit(n).select(*[f"a{i}" for i in range(self.arity)])


def _ddl(kinds: tuple[str, ...]) -> str:
    """Schema of a predicate's Parquet files, which can't be without columns."""
    return ", ".join(f"a{i} {sql_type(k)}" for i, k in enumerate(kinds)) or "holds boolean"


def _cast(col, kind: str, source: str):
    """A column of a registered DataFrame as the native column of a value type."""
    if kind == "instant":
        return col.cast("timestamp")
    if kind == "year_month" and source in ("date", "timestamp", "timestamp_ntz"):
        return (F.year(col) * 100 + F.month(col)).cast("int")
    if kind == "year" and source in ("date", "timestamp", "timestamp_ntz"):
        return F.year(col).cast("int")
    return col.cast(NATIVE[kind])


class Catalog:
    """Predicates by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.predicates: dict[str, Predicate] = {}
        #: file -> its lines that look like facts and are none (line, problem), of the last loading
        self.problems: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.predicates

    def get(self, name: str) -> Predicate | None:
        return self.predicates.get(name)

    def clear(self) -> None:
        self.predicates.clear()

    def register(self, name: str, df: DataFrame, columns: list[str] | None = None, kinds: dict[str, str] | None = None, distinct: bool = True, complete: bool = False) -> Predicate:
        """Make a predicate of columns of a DataFrame.

        ``kinds`` gives value types by column where the Spark type does not tell
        (whole numbers are integers, other numbers decimals, strings strings).
        Rows with a null are no facts; pass ``complete=True`` only for columns known
        to have none, so that columns a query does not need are not read for the test.
        Facts are a set: pass ``distinct=False`` only for rows known to be distinct,
        which saves a shuffle.
        """
        columns, kinds = columns or df.columns, kinds or {}
        found, cols, plain = [], [], []
        for i, c in enumerate(columns):
            source = df.schema[c].dataType.simpleString()
            kind = kinds.get(c) or INFERRED.get(source) or ("integer" if source in ("tinyint", "smallint", "int", "bigint") else None)
            kind = kind or ("decimal" if source in ("float", "double") or source.startswith("decimal") else None)
            if kind is None:
                raise CatalogError(f"{name}: no value type for column {c} of type {source}")
            found.append(kind)
            cols.append(_cast(F.col(f"`{c}`"), kind, source).alias(f"a{i}"))
            plain.append((c, source))
        for c in () if complete else columns:
            df = df.where(F.col(f"`{c}`").isNotNull())
        source = Source(df, tuple(plain), tuple(cols), distinct)
        return self._put(name, source.facts(), tuple(found), tuple(frozenset((k,)) for k in found), source=source)

    def union(self, name: str, parts: list[str]) -> Predicate:
        """A predicate of the facts of several of one arity; positions of several
        types hold them all.  Facts that more than one has are kept once."""
        ps = [self.predicates[p] for p in parts]
        if len({p.arity for p in ps}) != 1:
            raise CatalogError(f"{name}: predicates of different arity")
        kinds = tuple(k[0] if len(set(k)) == 1 else MIXED for k in zip(*(p.kinds for p in ps)))
        types = tuple(frozenset().union(*t) for t in zip(*(p.types for p in ps)))
        out = None
        for p in ps:
            cols = [(F.col(f"a{i}") if p.kinds[i] == k else lift(p.term(i))).alias(f"a{i}") for i, k in enumerate(kinds)]
            out = p.df.select(*cols) if out is None else out.unionAll(p.df.select(*cols))
        apart = any(not frozenset.intersection(*(p.types[i] for p in ps)) for i in range(len(kinds)))
        return self._put(name, out if apart else out.distinct(), kinds, types, parts=tuple(ps), apart=apart)

    def _put(self, name, df, kinds, types, home=None, **more) -> Predicate:
        self.predicates[name] = p = Predicate(name, df, kinds, types, home, **more)
        return p

    # -- facts as text ----------------------------------------------------------------

    def add_facts(self, parsed: DataFrame, name: str | None = None) -> dict[str, str]:
        """Add parsed facts to what there is; name -> what became of it.

        With ``name`` all facts are of that predicate (a file is named after its
        predicate); otherwise each line says its own.  A predicate with facts of
        different arity is not written.
        """
        got = parsed.where("problem IS NULL")
        if name is not None:
            got = got.withColumn("predicate", F.lit(name))
        # one row per predicate, arity, position and type: the schema, not data
        wide = F.col("arg.t").isin("date", "instant") & ~F.when(F.col("arg.t") == "date", text.fits_native(F.col("arg.o"), "date")).otherwise(text.fits_native(F.col("arg.o"), "instant"))
        shape = got.select("predicate", "arity", F.posexplode_outer("args").alias("pos", "arg")).groupBy("predicate", "arity", "pos", "arg.t").agg(F.max(F.coalesce(wide, F.lit(False))).alias("wide"), F.count("*").alias("n"))
        by: dict[str, dict[int, list]] = {}
        sizes: dict[str, int] = {}
        for r in shape.orderBy("predicate", "arity", "pos", "t").collect():
            by.setdefault(r["predicate"], {}).setdefault(r["arity"], []).append((r["pos"], r["t"], r["wide"]))
            sizes[r["predicate"]] = sizes.get(r["predicate"], 0) + (0 if r["pos"] else r["n"])
        said = {}
        for p, arities in by.items():
            old = self.get(p)
            if len(arities) > 1 or (old is not None and old.arity not in arities):
                said[p] = "arity mismatch, not written"
                continue
            [(n, seen)] = arities.items()
            types = tuple(frozenset(t for k, t, _ in seen if k == i) for i in range(n))
            big = [any(w for k, _, w in seen if k == i) for i in range(n)]
            df = got.where(F.col("predicate") == p).select(*[F.col("args")[i].alias(f"a{i}") for i in range(n)])
            if old is not None:
                df = df.unionByName(old.structs())
                big = [b or (k == MIXED and len(t) == 1) for b, k, t in zip(big, old.kinds, old.types)]
                types = tuple(a | b for a, b in zip(types, old.types))
            kinds = tuple(next(iter(t)) if len(t) == 1 and not b else MIXED for t, b in zip(types, big))
            # a native column tells values of one type apart as their texts do, and takes a part of the room
            df = df.select(*[from_struct(F.col(f"a{i}"), k).alias(f"a{i}") for i, k in enumerate(kinds)])
            self._put(p, df.dropDuplicates([f"a{i}" for i in range(n)]) if n else df.limit(1), kinds, types)
            mixed = [i for i in range(n) if len(types[i]) > 1]
            said[p] = f"written, {sizes[p]} facts" + (f"; several types at position {', '.join(map(str, mixed))}" if mixed else "")
        return said

    def add_lines(self, lines) -> dict[str, str]:
        return self.add_facts(text.from_lines(self.spark, [lines] if isinstance(lines, str) else list(lines)))

    def _read_text(self, path: str, by_predicate: bool) -> DataFrame:
        """Parsed facts of a text file; its other lines go to ``problems``.

        With a shared folder (``spark.checkpoint.dir``) the text is parsed once, into
        Parquet there (one folder a predicate if asked for); otherwise by each use.
        """
        parsed = text.read_facts(self.spark, path)
        if shared := self.spark.conf.get("spark.checkpoint.dir", None):
            staged = f"{shared.rstrip('/')}/quillfact-facts-{uuid.uuid4().hex}"
            parsed.write.partitionBy(*["predicate"] * by_predicate).parquet(staged)
            parsed = self.spark.read.schema(text.PARSED).parquet(staged)
        self.problems[path] = parsed.where("problem IS NOT NULL").select("line", "problem")
        return parsed

    def load_file(self, path: str) -> dict[str, str]:
        """Add the facts of a text file, each under the predicate its line names."""
        self.problems.clear()
        return self.add_facts(self._read_text(path, True))

    def compile_folder(self, folder: str) -> dict[str, str]:
        """A fresh catalog of the predicate files of a folder, each under its file's name."""
        self.clear()
        self.problems.clear()
        said = {}
        for name, path in text.list_predicates(self.spark, folder).items():
            said |= self.add_facts(self._read_text(path, False), name) or {name: "no facts"}
        return said

    # -- the store --------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Add a version to the store in the folder ``path``.

        Each predicate goes to a Parquet folder of its own, sorted within partitions
        so that row groups have narrow ranges to skip by; one that the store holds
        as it is keeps its folder.  What was written is counted once, and its count,
        manifest and first samples are stored with it, so that listings read no facts.
        The schemas, written last, make the version:
        readers see the old one until then, and no folder is ever rewritten, so a
        store can be saved to while it is read, also by this catalog.  Two writers at
        once get one version; the other fails.
        """
        path, rows = path.rstrip("/"), [("", "{}")]  # a version without predicates has a row too
        version = (self._last(self.spark, path) or 0) + 1
        for p in list(self.predicates.values()):
            home = p.home
            if home is None or not home.startswith(f"{path}/facts/"):
                home = f"{path}/facts/{p.name}-{uuid.uuid4().hex}"
                (p.df.sortWithinPartitions(*p.df.columns) if p.arity else p.df.select(F.lit(True).alias("holds"))).write.parquet(home)
                p = self._read(p.name, home, p.kinds, p.types)
            if p.known is None:
                p = self._put(p.name, p.df, p.kinds, p.types, home, known=self._counted(p, f"{path}/samples/{home.rsplit('/', 1)[1]}-{uuid.uuid4().hex}"))
            schema = {"kinds": p.kinds, "types": [sorted(t) for t in p.types], "folder": home.removeprefix(f"{path}/facts/"), "known": p.known.to_json()}
            rows.append((p.name, json.dumps(schema)))
        self.spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.parquet(f"{path}/schemas/version={version}")

    @staticmethod
    def _last(spark: SparkSession, path: str) -> int | None:
        """Number of the last version of a store, None if there is none."""
        try:
            found = spark.read.schema("name string, schema string, version long").parquet(f"{path}/schemas")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found.agg(F.max("version")).first()[0]

    def _counted(self, p: Predicate, samples: str) -> Known:
        """One row a position and type, and a bounded number of facts written to ``samples``."""
        rows = tuple(tuple(r) for r in self.manifest(p.name).orderBy("position", "type").collect())
        few = p.sample(KEPT_SAMPLES) if p.arity else p.df.limit(1).select(F.lit(True).alias("holds"))
        few.coalesce(1).write.parquet(samples)
        return Known(sum(r[2] for r in rows if r[0] == 0) if p.arity else p.df.count(), rows, samples)

    def _read(self, name: str, home: str, kinds: tuple, types: tuple, known: Known | None = None) -> Predicate:
        df = self.spark.read.schema(_ddl(kinds)).parquet(home)
        return self._put(name, df if kinds else df.select(), kinds, types, home, known=known)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        """The last version of the store in the folder ``path``."""
        path, out = path.rstrip("/"), cls(spark)
        if (version := cls._last(spark, path)) is None:
            raise CatalogError(f"no store in {path}")
        for r in spark.read.parquet(f"{path}/schemas/version={version}").where("name <> ''").collect():
            s = json.loads(r["schema"])
            k = s.get("known")
            known = k and Known(k["count"], tuple(map(tuple, k["manifest"])), f"{path}/samples/{k['samples']}")
            out._read(r["name"], f"{path}/facts/{s['folder']}", tuple(s["kinds"]), tuple(map(frozenset, s["types"])), known)
        return out

    # -- statistics -------------------------------------------------------------------

    def manifest(self, name: str) -> DataFrame:
        """Per position and type: position, type, count, distinct_count, min and max
        (canonical text; null for types without order).  A store's predicate has it stored."""
        p = self.predicates[name]
        if p.known is not None:
            return self.spark.createDataFrame(list(p.known.manifest), MANIFEST)
        parts = []
        for i in range(p.arity):
            t = p.term(i)
            tag = t.col["t"] if t.kind == MIXED else F.lit(t.kind)
            # the distinct values are counted from their own counts: one shuffle of map-side combined rows
            each = p.df.select(tag.alias("type"), canonical(t.col, t.kind).alias("v"), order_key(t.col, t.kind).alias("o")).groupBy("type", "v").agg(F.count("*").alias("n"), F.first("o").alias("o"))
            keep = F.col("type").isin(*ORDERED)
            parts.append(
                each.groupBy("type")
                .agg(F.sum("n").alias("count"), F.count("*").alias("distinct_count"), F.min(F.when(keep, F.struct("o", "v"))).alias("lo"), F.max(F.when(keep, F.struct("o", "v"))).alias("hi"))
                .select(F.lit(i).alias("position"), "type", "count", "distinct_count", F.col("lo.v").alias("min"), F.col("hi.v").alias("max"))
            )
        out = parts[0] if parts else self.spark.createDataFrame([], MANIFEST)
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
