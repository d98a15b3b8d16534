"""Shared plumbing: the shared folder, Arrow maps with bounded batches, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to a Python worker.  Texts are unbounded in
#: length, so batches hold few rows; a worker handles one row at a time.
BATCH_ROWS = 512

#: Rows (of a few numbers each) up to which Catalyst may broadcast a table that grows
#: with the input.  The driver holds all of a broadcast, and its size is foretold from
#: compressed files and without what ``explode`` makes of a row.
BROADCAST_ROWS = 100_000

_created: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent on one machine, as in tests, is a folder of
    our own set; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillfact-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _delete(jvm, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(p, True)


def _sweep() -> None:
    for jvm, path in _created:
        try:
            _delete(jvm, path)
        except Exception:  # the session has gone: the folder's owner clears it
            return


atexit.register(_sweep)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillfact-{uuid.uuid4().hex}-{name}"
    _created.append((spark.sparkContext._jvm, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs no recomputation, and gives
    Catalyst the size of its files, so that a later join is broadcast only if
    that size is below ``spark.sql.autoBroadcastJoinThreshold`` (see ``sized``
    for tables that grow with the input).
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a side of a join with at most ``rows`` rows: by sort and merge if they are many, as Catalyst likes if few."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def _discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    _delete(spark.sparkContext._jvm, path)
    _created[:] = [x for x in _created if x[1] != path]


def col(name: str):
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``alias=column`` only, so that other columns never clash."""
    return df.select(*[col(c).alias(a) for a, c in columns.items()])


def arrow_map(df: DataFrame, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """``mapInArrow`` where ``start()`` runs once a task and returns
    ``f(batch) -> list of column values`` in the order of ``schema``.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        f = start()
        for batch in batches:
            cols = f(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, fields, strict=True)], schema=fields
            )

    return df.mapInArrow(run, schema)


def texts(batch, name: str = "text") -> list[str]:
    """A batch's column as Python strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph as (node, comp), comp the least node.

    ``edges`` has two comparable columns a, b; nodes without edges are absent.
    Alternates large-star and small-star steps (Kiveris et al., 2014), which
    end after a logarithmic number of rounds on graphs met in practice.  Each
    round is written to the shared folder, so lineage stays short, and the round
    before it is removed; nothing but a count and a checksum reaches the driver, and
    tables of nodes only if they are few (``BROADCAST_ROWS``).
    The edges of a hub, which meet its one least neighbour, are split over tasks by
    adaptive execution where they are more than a partition's size.
    """
    a, b = F.col("a"), F.col("b")
    kind = edges.schema["a"].dataType
    spark = edges.sparkSession
    cur, path = _written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    last, rows = None, cur.count()
    for _ in range(max_rounds):
        both = cur.select(a, b).union(cur.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(sized(low, 2 * rows), "a").select(b.alias("a"), F.col("m").alias("b"))
        # an edge to the least neighbour stands for each node that was its own least
        small_in = large.where(a != b).distinct()
        low2 = small_in.groupBy("a").agg(F.min("b").alias("m"))
        small = small_in.join(sized(low2, 2 * rows), "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        before = path
        cur, path = _written(small.where(a != b).select("a", "b").distinct(), "edges")
        _discard(spark, before)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last, rows = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(b.cast(kind).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return cur.select(a.alias("node"), b.alias("comp")).unionByName(roots)
