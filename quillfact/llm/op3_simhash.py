"""SimHash near-duplicates by a segment-popcount embedding.

Method.  A 64-bit fingerprint is cut into 16 segments of four bits; the vector
of their bit counts is its embedding.  The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so a range join within
Manhattan distance 2 on the integer grid of embeddings loses no pair.  The join
is by meeting points: each fingerprint goes to its own cell and to the cells one
step away (at most 33), where any two within distance 2 meet.  Cells with a
single fingerprint are dropped by that bound.  What is left is verified exactly:
in a shared cell each fingerprint names the values at most one flipped bit away
that lie in this cell, and two fingerprints are within two bits exactly if they
name the same value.  A value thus links all that name it to the least of them:
no pair is ever emitted, however large a group of near copies is, and the work
is linear in the number of distinct fingerprints.

Defined cases: null, empty or blank text has no word and fingerprint zero,
linked like any other; fewer than three words make one shingle of the whole
sequence; repeated rows are rows of their own; a null id takes part in linking
but is never the name of a component (a component of null ids has a null name);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, materialize, pick, sized, texts

SEED = 42
SHINGLE_WORDS = 3
SEGMENTS = 16  # of four bits each
MAX_BITS = 2  # the meeting-point join below is made for this bound
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of 3-word shingles; A-Z lower-cased, words split on ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    digest, seed, space = xxhash.xxh64_intdigest, SEED, b" "
    if len(words) <= SHINGLE_WORDS:
        return digest(space.join(words), seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE_WORDS - 1]
        h = np.array([digest(b"%b %b %b" % s, seed) for s in zip(part, part[1:], part[2:])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """(doc_id, fp) and columns ``keep`` (alias -> column): the fingerprint of each row as a signed 64-bit integer."""
    keep = keep or {}
    kinds = "".join(f", `{a}` {df.schema[c].dataType.simpleString()}" for a, c in keep.items())

    def start():
        def f(batch):
            fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            return [batch.column("doc_id"), fps, *(batch.column(a) for a in keep)]

        return f

    return arrow_map(pick(df, doc_id=id_col, text=text_col, **keep), f"doc_id {df.schema[id_col].dataType.simpleString()}, fp long{kinds}", start)


def _segment_counts(fp):
    """The 16 bit counts of four-bit segments, packed four bits each, as one long."""

    def half(x):
        return x - F.shiftright(x, 1).bitwiseAND(F.lit(0x77777777)) - F.shiftright(x, 2).bitwiseAND(F.lit(0x33333333)) - F.shiftright(x, 3).bitwiseAND(F.lit(0x11111111))

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def _flip(fp, bit: int):
    return fp.bitwiseXOR(F.lit((1 << bit) if bit < 63 else -(1 << 63)).cast("long"))


def near_links(fps: DataFrame) -> DataFrame:
    """Star edges (a, b) over distinct fingerprints ``fp`` that connect exactly
    the fingerprints reachable through steps of at most two differing bits."""
    fp, p = F.col("fp"), F.col("p")
    moves = [F.struct(p.alias("cell"), F.lit(-1).alias("seg"), F.lit(0).alias("step"))]
    for s in range(SEGMENTS):
        count = F.shiftrightunsigned(p, 4 * s).bitwiseAND(F.lit(15))
        unit = F.lit(1 << (4 * s)).cast("long")
        moves.append(F.when(count < 4, F.struct((p + unit).alias("cell"), F.lit(s).alias("seg"), F.lit(1).alias("step"))))
        moves.append(F.when(count > 0, F.struct((p - unit).alias("cell"), F.lit(s).alias("seg"), F.lit(-1).alias("step"))))
    # each small row becomes 33: deal them out first, as the small table is read in few partitions
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = dealt.select("fp", _segment_counts(fp).alias("p")).select("fp", F.explode(F.filter(F.array(*moves), lambda m: m.isNotNull())).alias("m")).select("fp", "m.*")
    shared = placed.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    # merged whatever the size foretold, which leaves the 33 rows of each out: the driver would hold what is broadcast
    left = placed.join(shared.hint("merge"), "cell")
    # the values of this cell at most one bit away: itself, or one bit of the moved segment flipped
    bits = [
        F.when((F.col("step") == F.when(_bit(fp, F.col("seg") * 4 + k) == 1, -1).otherwise(1)), fp.bitwiseXOR(_one(F.col("seg") * 4 + k)))
        for k in range(4)
    ]
    values = F.when(F.col("seg") < 0, F.array(fp)).otherwise(F.filter(F.array(*bits), lambda v: v.isNotNull()))
    named = left.select("fp", F.explode(values).alias("v"))
    least = named.groupBy("v").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).where("b <> hi").select("v", "b")
    return named.join(least.hint("merge"), "v").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _one(at):
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _bit(fp, at):
    return F.call_function("shiftrightunsigned", fp, at).bitwiseAND(F.lit(1).cast("long"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (least doc_id reachable), kept.

    ``row_col`` tells rows of one id apart; with it there are also ``row`` (its value) and
    ``stands``: whether the row is, or equals, the one that stands for its component, which
    is the least by id, null last, then by ``row``.
    """
    docs = materialize(fingerprints(df, id_col, text_col, {"row": row_col} if row_col else None), "fingerprints")
    least = {"least": F.min("doc_id")}
    if row_col:
        least["first"] = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    distinct = materialize(docs.groupBy("fp").agg(*[x.alias(a) for a, x in least.items()]), "distinct")
    n = distinct.count()
    comp = connected_components(near_links(distinct.select("fp")))
    of = distinct.join(sized(comp.withColumnRenamed("node", "fp"), n), "fp", "left").select("fp", *least, F.coalesce("comp", "fp").alias("comp"))
    of = materialize(of, "classes")
    names = of.groupBy("comp").agg(*[F.min(a).alias(f"of_{a}") for a in least])
    named = of.join(sized(names, n), "comp").select("fp", F.col("of_least").alias("component_id"), *[f"of_{a}" for a in least if a == "first"])
    kept = [F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")]
    if row_col:
        kept += ["row", (F.col("doc_id").eqNullSafe(F.col("of_first.doc_id")) & F.col("row").eqNullSafe(F.col("of_first.row"))).alias("stands")]
    return docs.join(sized(named, docs.count()), "fp").select("doc_id", "fp", "component_id", *kept)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")
