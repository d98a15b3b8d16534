"""WARC archives: deduplicating writer, and a reader by boundary-chain verification.

Writer.  Every row becomes one WARC/1.1 record around an HTTP response.  Of the
rows with equal payloads of at least ``min_bytes`` bytes, that with the least
page id is a ``response``; the others are ``revisit`` records that refer to it
and repeat only the HTTP header.  Spark's text sink writes the files: a record
ends with CR LF CR LF, which is the sink's line separator, so a file is nothing
but its records.  Only payload digests that occur twice are joined back; that
table is written first, so Catalyst knows its size and broadcasts it only when
small.

Reader.  Files are read in splits, cut at each occurrence of the version line,
which may also stand inside a payload.  Each task emits, for every occurrence, a
candidate record: its offset and, from its Content-Length, the offset of its
successor.  Lengths summed in file order turn offsets within a split into
offsets in the file.  Within a split a task follows the chain of each candidate
to where it leaves the split; these exits are then followed across splits by
pointer jumping from offset zero (the pointer of each candidate is replaced by
the pointer of its pointer, so a chain of n splits takes log n rounds).  Only
candidates on the chain from the start of the file are records.  A record whose
payload was cut by an occurrence in it is put together again from its pieces by
a second read of just that file.

Defined cases: null html is an empty payload; a null page id is written as
``null`` and read as null, and comes last among equal payloads; repeated rows
(same id and payload) give one response and revisits of it; line ends in a url
are percent-encoded; an empty table gives no record; other columns are ignored;
a record that runs past the end of its file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_map, materialize, pick, scratch_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _sha1_base32(payload):
    """Upper-case base32 of the SHA-1 of a binary column, from its 40 hexadecimal digits."""
    hexed = F.sha1(payload)
    digit = lambda i: F.substring(
        F.lit(_BASE32),
        F.shiftright(F.conv(F.substring(hexed, 1 + 5 * (i // 4), 5), 16, 10).cast("int"), 15 - 5 * (i % 4)).bitwiseAND(F.lit(31)) + 1,
        F.lit(1),
    )
    return F.concat(*[digit(i) for i in range(32)])


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """One WARC record (``value``, without its final CR LF CR LF) for every row."""
    rows = pick(df, page_id=id_col, url=url_col, html=html_col)
    rows = rows.withColumns({"page_id": F.col("page_id").cast("long"), "html": F.coalesce("html", F.lit(""))})
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", _sha1_base32(F.col("html").cast("binary")))
    long_enough = F.col("bytes") >= min_bytes
    copies = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies.select("digest", "least"), "copies")
    joined = rows.join(copies.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & long_enough, "left")
    # rows of the least id itself: usually one; of repeated rows, counted before they are put in order, one is the response
    least = joined.where(F.col("d").isNotNull() & F.col("page_id").eqNullSafe(F.col("least")))
    counted = least.groupBy("digest", "page_id", "url", "least", "bytes").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("url").asc_nulls_last()))
    same = counted.withColumn("turn", turn).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    same = same.select("page_id", "url", "html", "bytes", "digest", "least", ((F.col("turn") > 1) | (F.col("k") > 1)).alias("again"))
    others = joined.where(F.col("d").isNull() | ~F.col("page_id").eqNullSafe(F.col("least")))
    both = same.unionByName(others.select("page_id", "url", "html", "bytes", "digest", "least", F.col("d").isNotNull().alias("again")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    again = F.col("again")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("least"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length("http") + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    return both.withColumn("http", http).select(F.concat(head, F.col("http"), F.when(again, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(df: DataFrame, path: str, **columns) -> str:
    """Write archives for the rows of ``df`` into the folder ``path``."""
    records(df, **columns).write.option("lineSep", END).text(path)
    return path


_HEAD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


class Head:
    """Header of a candidate; ``size`` is the whole record with its end, None if there is no valid header."""

    def __init__(self, data: bytes, magic: int = len(MAGIC)):
        self.size, self.body = None, None
        at = data.find(b"\r\n\r\n")
        if at < 0:
            return
        self.fields = {k.lower(): v for k, v in _HEAD.findall(data[: at + 2])}
        length = self.fields.get(b"content-length", b"")
        if length.isdigit() and b"warc-type" in self.fields:
            self.body = at + 4
            self.size = magic + at + 4 + int(length) + 4


def _page(name: bytes | None) -> int | None:
    name = (name or b"").decode()
    return int(name[10:-1]) if name.startswith("<urn:page:") and name != "<urn:page:null>" else None


def _record(head: Head, data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a whole record (without version line)."""
    http, _, payload = data[head.body : len(data) - 4].partition(b"\r\n\r\n")
    kind = head.fields[b"warc-type"].decode()
    said = head.fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http + b"\r\n")[1])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said):
        raise ValueError(f"payload of {head.fields.get(b'warc-record-id')!r} does not fit its header")
    return _page(head.fields.get(b"warc-record-id")), size, said, kind, _page(head.fields.get(b"warc-refers-to")) if kind == "revisit" else None


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD_COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
CANDIDATE = f"file string, block long, at long, len long, size long, exit long, whole boolean, {RECORD}"


def _pieces(spark: SparkSession, path) -> DataFrame:
    """(file, block, value): what follows each version line up to the next, in file order within a block."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _bounded(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def candidates(spark: SparkSession, path) -> DataFrame:
    """All occurrences of the version line, with offsets within their split.

    ``at``: offset of the piece in its split; ``len``: of version line and piece;
    ``size``: of the candidate record, null if it has no header; ``exit``: the
    first offset on its chain that is no candidate's of this split; ``whole``:
    the piece is exactly the record, and its fields are given.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    _bounded(spark)
    schema = to_arrow_schema(spark.createDataFrame([], CANDIDATE).schema)
    magic = len(MAGIC)

    def run(batches):
        here, at, rows = None, 0, []

        def closed():
            leaves: dict[int, int] = {}
            for r in reversed(rows):
                if r[4] is not None:
                    to = r[2] + r[4]
                    r[5] = leaves[r[2]] = leaves.get(to, to)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                if (file, block) != here:
                    if rows:
                        yield closed()
                    here, at, rows = (file, block), 0, []
                    if block == 0:  # what precedes the first version line: nothing in a sound file
                        if value:
                            raise ValueError(f"{file} does not begin with {MAGIC!r}")
                        continue
                head, size = Head(value), len(value) + magic
                whole = head.size == size
                rows.append([file, block, at, size, head.size, None, whole, *(_record(head, value) if whole else [None] * 5)])
                at += size
        if rows:
            yield closed()

    return _pieces(spark, path).mapInArrow(run, CANDIDATE)


def _reached(exits: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, offset) reachable from ``starts`` through ``exits`` (file, offset, to), by pointer jumping."""
    jump, seen = exits, materialize(starts, "reached")
    n = seen.count()
    while True:
        step = seen.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        seen = materialize(seen.union(step).distinct(), "reached")
        if (now := seen.count()) == n:
            return seen
        n = now
        on = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        jump = materialize(jump.join(on, ["file", "to"]).select("file", "offset", F.col("next").alias("to")), "jump")


def read(spark: SparkSession, path) -> DataFrame:
    """Records of the archives at ``path``: the columns of ``RECORD``."""
    got = materialize(candidates(spark, path), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = got.groupBy("file", "block").agg(F.sum("len").alias("len")).withColumn("base", F.coalesce(F.sum("len").over(before), F.lit(0)))
    blocks = materialize(blocks, "blocks")
    based = got.join(blocks.select("file", "block", "base"), ["file", "block"])
    placed = based.select("file", "block", (F.col("base") + F.col("at")).alias("offset"), (F.col("base") + F.col("at") + F.col("size")).alias("next"), (F.col("base") + F.col("exit")).alias("to"), "len", "whole", *_RECORD_COLS)
    # chains enter a split only where a chain of another leaves to, so only those candidates' exits are followed
    exits = placed.select("file", "offset", "to").where("to IS NOT NULL")
    doors = exits.select("file", F.col("to").alias("offset")).union(blocks.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    exits = materialize(exits.join(doors, ["file", "offset"], "left_semi"), "exits")
    starts = blocks.select("file", F.lit(0).cast("long").alias("offset")).distinct()
    entries = _reached(exits, starts)
    marked = placed.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left")
    marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "offset")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    walked = ["file", "block", "offset", "next", "len", "whole", *_RECORD_COLS]

    def walk(batches):
        here, at, owner = None, None, None
        for batch in batches:
            keep, own = [], []
            cols = [batch.column(c).to_pylist() for c in ("file", "block", "offset", "next", "entry")]
            for file, block, offset, to, entry in zip(*cols):
                if (file, block) != here:
                    here, at, owner = (file, block), None, None
                if entry or offset == at:
                    at, owner = to, offset
                keep.append(owner == offset)
                own.append(owner)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in walked), pa.array(keep, pa.bool_()), pa.array(own, pa.int64())], names=[*walked, "record", "owner"])

    true = materialize(marked.mapInArrow(walk, ", ".join([f"{c} {kinds[c]}" for c in walked] + ["record boolean", "owner long"])), "chain")
    cut = true.where("record AND NOT whole").select("file", F.col("offset").alias("start"), F.col("next").alias("stop"))
    out = true.where("record AND whole").select(*_RECORD_COLS)
    torn = cut.agg(F.count("*"), F.collect_set("file")).first() if cut.limit(1).count() else (0, [])
    return out if not torn[0] else out.unionByName(_mended(spark, torn[1], cut, true, blocks))


def _mended(spark: SparkSession, files: list[str], cut: DataFrame, true: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records with a version line inside: their pieces read again and joined.

    ``files`` are names of archives that hold such records, not data: no more than
    the listing of the archives that Spark's driver holds in any case.
    """
    magic = MAGIC.encode()

    def offsets():
        state = {}

        def f(batch):
            at = []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                if (file, block) not in state:
                    state.clear()
                    state[file, block] = -len(magic) if block == 0 else 0
                at.append(state[file, block])
                state[file, block] += len(value) + len(magic)
            return [batch.column("file"), batch.column("block"), at, batch.column("value")]

        return f

    pieces = arrow_map(_pieces(spark, files), "file string, block long, at long, value binary", offsets)
    pieces = pieces.join(blocks.select("file", "block", "base"), ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("offset"), "value")
    # the record a piece belongs to: the last on the chain that begins at or before it, in its split or in one before
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = true.groupBy("file", "block").agg(F.max("owner").alias("own")).select("file", "block", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    owned = true.join(carried, ["file", "block"]).select("file", "offset", F.coalesce("owner", "carried").alias("start"))
    owned = owned.join(cut, ["file", "start"], "left_semi")
    parts = pieces.join(owned, ["file", "offset"]).groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))

    def start():
        def f(batch):
            rows = []
            for parts_ in batch.column("parts").to_pylist():
                data = magic.join(p["value"] for p in parts_)
                head = Head(data)
                if head.size != len(data) + len(magic):
                    raise ValueError("a record runs past the end of its file")
                rows.append(_record(head, data))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in _RECORD_COLS]

        return f

    return arrow_map(parts.select("parts"), RECORD, start)


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc")))


ORACLE_SQL = r"""
WITH rows AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, coalesce(html, '') AS html FROM pages),
hashed AS (
  SELECT *, strlen(html) AS payload_bytes, CAST(CAST(from_hex(sha1(html)) AS BIT) AS VARCHAR) AS bits,
    row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS k, min(page_id) OVER (PARTITION BY html) AS least
  FROM rows)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INT), 1) AS INT) * (16 >> CAST(j AS INT)))) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to
FROM hashed
"""
