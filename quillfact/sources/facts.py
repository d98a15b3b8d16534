"""Facts as text: files and directories, parsed by the executors."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.columns import DAYS, MICROS, MIXED, STRUCT, Term, canonical
from ..plans.parse import ParseError, fact

PARSED = f"predicate string, arity int, args array<{STRUCT}>, problem string, line string"
SKIPPED = (".sh", ".md", ".txt", ".json", ".yml", ".yaml")
FACT_FILES = (".pl", ".pro", ".facts")


def _parsed(line: str) -> tuple | None:
    try:
        got = fact(line)
    except ParseError as e:
        return None, None, None, str(e), line
    if got is None:
        return None
    name, args = got
    for v in args:
        if v.order is not None and (v.order.as_tuple().exponent < -18 or v.order.adjusted() >= 20):
            return None, None, None, f"{v.text} needs more than 20 digits before or 18 after the point", line
    return name, len(args), [(v.type, v.text, v.order) for v in args], None, line


#: What most lines are made of: short numbers, texts without escapes, days, names.
_ARG = r"[ \t]*(?:(-?\d{1,18})|(-?\d{1,9}\.\d{1,9})|\"([^\"\\]*)\"|@(\d{4}-\d\d-\d\d)|([A-Za-z][A-Za-z0-9_]*))[ \t]*"
_ARGS = re.compile(rf"{_ARG}(?:,|\Z)", re.ASCII)
_EASY = re.compile(rf"([A-Za-z][A-Za-z0-9_]*)[ \t]*\((({_ARG},)*{_ARG})\)\.?", re.ASCII)
_day = lru_cache(1 << 16)(V.temporal)


def _easy(line: str) -> tuple | None:
    """``_parsed`` of a line of the common kind, several times as fast; None for any other."""
    if (m := _EASY.fullmatch(line)) is None:
        return None
    args = []
    for whole, number, body, day, name in _ARGS.findall(m[2]):
        if whole:
            n = int(whole)
            args.append(("integer", str(n), Decimal(n)))
        elif number:
            if number[-1] == "0" or number.lstrip("-")[0] == "0":
                v = V.decimal(number)
                args.append(("decimal", v.text, v.order))
            else:
                args.append(("decimal", number, Decimal(number)))
        elif day:
            try:
                v = _day(day)
            except V.ValueError_:
                return None
            args.append(("date", v.text, v.order))
        elif name:
            args.append(("boolean" if name in ("true", "false") else "atom", name, None))
        else:
            args.append(("string", body, None))
    return m[1], len(args), args, None, line


def _batch(lines, schema: pa.Schema) -> pa.RecordBatch:
    """Parsed lines as columns, made of flat lists: a row of objects for each value is slow."""
    rows = [r for s in lines if s is not None and (r := _easy(s) or _parsed(s)) is not None]
    starts, values = [], []
    for r in rows:
        starts.append(None if r[2] is None else len(values))
        values += r[2] or ()
    starts.append(len(values))
    kind = schema.field("args").type
    each = [pa.array(x, f.type) for x, f in zip(zip(*values) if values else ((), (), ()), kind.value_type)]
    args = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(each, fields=list(kind.value_type)), type=kind)
    cols = {f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema) if f.name != "args"}
    return pa.RecordBatch.from_arrays([args if f.name == "args" else cols[f.name] for f in schema], schema=schema)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Facts of a DataFrame with one string column: predicate, arity, args, problem, line.

    Blank lines, comments and other text are left out; a line that looks like a
    fact and is none has its reason in ``problem``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(lines.sparkSession.createDataFrame([], PARSED).schema)

    def run(batches):
        for batch in batches:
            yield _batch(batch.column(0).to_pylist(), schema)

    return lines.mapInArrow(run, PARSED)


def read_facts(spark: SparkSession, path) -> DataFrame:
    """Parsed facts of text files: any path that Spark reads."""
    return parse_lines(spark.read.text(path).select("value"))


def from_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return parse_lines(spark.createDataFrame([(x,) for s in lines for x in s.split("\n")], "value string"))


def list_predicates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Predicate name -> file of a folder, or of its ``predicates`` folder if it has one.

    The folder may lie on any file system that Spark reads.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    inner = hadoop.Path(folder, "predicates")
    there = inner if files.exists(inner) and files.getFileStatus(inner).isDirectory() else hadoop.Path(folder)
    found = {s.getPath().getName(): s.getPath().toString() for s in files.listStatus(there) if not s.isDirectory()}
    out: dict[str, str] = {}
    for name in sorted(found):
        if name.startswith(".") or name.upper().startswith("README") or name.endswith(SKIPPED):
            continue
        bare = name.removesuffix(".pl")
        if bare not in out or name.endswith(".pl"):  # p.pl goes before p
            out[bare] = found[name]
    return out


def load_kind(path: str) -> str:
    """``facts`` or ``queries``, by the ending of a file's name."""
    return "facts" if path.lower().endswith(FACT_FILES) else "queries"


def write_facts(facts: DataFrame, predicate: str, path: str, terms: tuple[Term, ...] = ()) -> None:
    """Write a predicate's arguments (struct columns) as text, one fact a line.

    With ``terms`` the arguments are those of the columns themselves: for a column of
    one type, only that type's text is made, and no order key.
    """
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))

    def shown(text, tag):
        body = F.regexp_extract(text, r"(?s)^(.*)@([^@]*)$", 1)
        temporal = tag.isin("year", "year_month", "date", "instant")
        return (
            F.when(tag == "string", quote(text))
            .when(tag == "lang_string", F.concat(quote(body), F.lit("@"), F.regexp_extract(text, r"(?s)^(.*)@([^@]*)$", 2)))
            .when(tag == "uri", F.concat(F.lit("<"), text, F.lit(">")))
            .when(temporal, F.concat(F.lit("@"), text))
            .when(tag == "decimal", F.concat(text, F.when(text.contains("."), "").otherwise(".0")))
            .otherwise(text)
        )

    terms = terms or tuple(Term(F.col(c), MIXED, frozenset()) for c in facts.columns)
    args = [shown(canonical(t.col, t.kind), t.col["t"] if t.kind == MIXED else F.lit(t.kind)) for t in terms]
    facts.select(F.concat(F.lit(f"{predicate}("), F.concat_ws(", ", *args), F.lit(").")).alias("value")).write.mode("overwrite").text(path)


def fits_native(o, kind: str):
    """Whether an order key of a date or instant fits Spark's type."""
    if kind == "date":
        return (o >= DAYS[0]) & (o <= DAYS[1])
    return (o * 1_000_000 == F.floor(o * 1_000_000)) & (o >= MICROS[0] / 1_000_000) & (o <= MICROS[1] // 1_000_000)
