"""Embedding near-duplicates by spherical-cap filters.

Method.  Vectors are first turned by a fixed random rotation (three rounds of random
signs and a Hadamard transform, in ``WIDTH`` dimensions at least), so that it does not
matter where a vector's weight lies or how few dimensions it has.  Filter directions
come from a structured random product code: the
coordinates are cut into two parts, each part has ``CODEWORDS`` random
unit vectors, and every combination of one codeword a part, scaled to length
one, is a filter (``CODEWORDS ** 2``, about a million).  A vector's filters
are all whose inner product with it reaches a threshold: the caps that contain
it.  Product structure makes the list cheap: sort the scores of each part, then
read off combinations that reach the threshold.  Vectors are joined on (label,
filter), and pairs that meet are verified by their cosine in double precision.

The threshold gives ``EXPECTED`` filters to a random vector; a vector with fewer
than ``LEAST`` takes its own threshold from its ``LEAST`` best, so none is left
with a poor chance of meeting its neighbours, and one with more than ``MOST`` from
its ``MOST`` best.  Recall on links at cosine 0.98 and above is measured against brute
force in the tests, over 0.99 from 2 to 768 dimensions for isotropic, half-zero,
non-negative and nearly one-hot vectors.

Equal vectors of a label are first folded into one with a weight, so copies are
never paired.  Filters with one vector are dropped before vectors are sent
anywhere.  A filter with more than ``SLICE`` vectors is dealt into slices, and
each pair of slices is a unit of work of its own; inside a unit, links are
counted by matrix products, and only weights and one edge a vector come out.  A
pair that meets in several filters is counted in the least of them only.

Defined cases: a vector that is null, zero, or holds null or non-finite values,
or has a null label, links with nothing and is its own component; vectors of
different lengths never link; repeated rows are rows of their own and link; a
null id counts as a link but names no component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, materialize, pick

MIN_COSINE = 0.98
CODEWORDS = 1024
EXPECTED = 32
LEAST = 16
MOST = 64
WIDTH = 64
#: Ranks in the two parts among which the MOST best combinations are: (i + 1) (j + 1) others are no worse.
BEST = np.array([(i, j) for i in range(MOST) for j in range(MOST // (i + 1))]).T
SLICE = 1024
SEED = 20240607


def _quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - p)


class Filters:
    """Rotation and product code of one dimension, and list decoding."""

    def __init__(self, dim: int):
        self.size = max(WIDTH, 1 << (dim - 1).bit_length())
        rng = np.random.default_rng([SEED, dim])
        self.signs = rng.choice([-1.0, 1.0], (3, self.size))
        half = self.size // 2
        self.code = []
        for _ in range(2):
            c = rng.standard_normal((CODEWORDS, half))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2))
        self.threshold = _quantile(EXPECTED / CODEWORDS**2) / np.sqrt(self.size)

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        """Rows turned, lengths kept."""
        n, size = len(unit), self.size
        x = np.zeros((n, size))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs:
            x *= signs
            h = 1
            while h < size:
                y = x.reshape(n, -1, 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
                h *= 2
            x /= np.sqrt(size)
        return x

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row, the sorted numbers of all filters that reach its threshold."""
        x = self.rotate(unit)
        half = self.size // 2
        scores = [x[:, :half] @ self.code[0].T, x[:, half:] @ self.code[1].T]
        orders = [np.argsort(-s, axis=1, kind="stable") for s in scores]
        ranked = [np.take_along_axis(s, o, 1) for s, o in zip(scores, orders)]
        best = -np.sort(-(ranked[0][:, BEST[0]] + ranked[1][:, BEST[1]]), axis=1)
        limits = np.minimum(np.maximum(self.threshold, best[:, MOST - 1]), best[:, LEAST - 1])
        out = []
        for k, (x, y, limit) in enumerate(zip(*ranked, limits)):
            # the same sums that made the limit are compared with it, so that none is lost by rounding
            rows, cols = int((x + y[0] >= limit).sum()), int((x[0] + y >= limit).sum())
            i, j = np.nonzero(x[:rows, None] + y[None, :cols] >= limit)
            out.append(np.sort(orders[0][k][i] * CODEWORDS + orders[1][k][j]))
        return out


def _matrix(column, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def keyed(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, key, embedding): key tells equal vectors of one label, null if it can't link."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        def f(batch):
            keys, vectors = [], []
            for v, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                key = None
                if v and label is not None and None not in v:
                    x = np.array(v, np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        key = hashlib.blake2b(x.tobytes() + b"|" + label.encode(), digest_size=16).digest()
                keys.append(key)
                vectors.append(v if key is not None else None)
            return [batch.column("vec_id"), batch.column("label"), keys, vectors]

        return f

    got = pick(df, vec_id=id_col, embedding=vector_col, label=label_col)
    got = got.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("label", F.col("label").cast("string"))
    return arrow_map(got, f"vec_id {kind}, label string, key binary, embedding array<double>", start)


def _decoded(distinct: DataFrame) -> DataFrame:
    """(label, dim, filter, key), one row for each filter of each distinct vector."""

    def start():
        made: dict[int, Filters] = {}

        def f(batch):
            keys, labels = batch.column("key"), batch.column("label")
            dims = np.array([len(v) for v in batch.column("embedding").to_pylist()], np.int64)
            rows, dim, filt = [], [], []
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                x = _matrix(batch.column("embedding").take(pa.array(at)), len(at))
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                code = made.setdefault(int(d), Filters(int(d)))
                for r, fs in zip(at, code.decode(x)):
                    rows.append(np.full(len(fs), r))
                    dim.append(np.full(len(fs), d))
                    filt.append(fs)
            join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            take = pa.array(join(rows), pa.int64())
            return [labels.take(take), pa.array(join(dim)).cast("int32"), pa.array(join(filt), pa.int64()).cast("int32"), keys.take(take)]

        return f

    return arrow_map(distinct.select("label", "key", "embedding"), "label string, dim int, filter int, key binary", start)


def _least_common(filters: list[np.ndarray], here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows a x b: whether they share no filter below ``here``."""
    flat = np.concatenate([f[f < here] for f in filters]) if filters else np.zeros(0, int)
    known, n = np.unique(flat, return_counts=True)
    known = known[n > 1]
    shared = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(known), 2048):
        part = known[k : k + 2048]
        has = np.zeros((len(filters), len(part)), np.float32)
        for r, f in enumerate(filters):
            at = np.searchsorted(part, f)
            ok = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == f)
            has[r, at[ok]] = 1
        shared |= has[a] @ has[b].T > 0
    return ~shared


def links_of_unit(x: np.ndarray, weight: np.ndarray, side: np.ndarray, filters: list[np.ndarray], here: int, same: bool):
    """(weight of new links, least row linked through this unit) for each row.

    ``same``: all pairs of rows; otherwise pairs between side 0 and side 1.
    """
    n = len(x)
    norm = np.sqrt((x * x).sum(1))
    a, b = (np.arange(n), np.arange(n)) if same else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
    linked = np.zeros((n, n), bool)
    linked[np.ix_(a, b)] = (x[a] @ x[b].T) / norm[a][:, None] / norm[b][None, :] >= MIN_COSINE
    linked |= linked.T
    np.fill_diagonal(linked, False)
    got, root = np.zeros(n, np.int64), np.arange(n)
    rows = np.nonzero(linked.any(1))[0]
    if len(rows):
        m = linked[np.ix_(rows, rows)]
        k = np.arange(len(rows))
        new = m & _least_common([filters[r] for r in rows], here, k, k)
        got[rows] = new @ weight[rows]
        lab = k.copy()
        while True:
            low = np.minimum(lab, np.where(m, lab[None, :], len(rows)).min(1))
            if (low == lab).all():
                break
            lab = low
        root[rows] = rows[lab]
    return got, root


def links(distinct: DataFrame) -> DataFrame:
    """(key, links, root): partial link weights and star edges of the distinct vectors."""
    where = ["label", "dim", "filter"]
    met = materialize(_decoded(distinct), "filters")
    full = met.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1")
    left = met.join(full, where)
    of = met.groupBy("key").agg(F.sort_array(F.collect_list("filter")).alias("filters"))  # one vector's list, set by the threshold
    vectors = distinct.select("key", "embedding", "weight").join(of, "key")
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("key", "filter"), slices).cast("int")
    dealt = left.withColumn("slices", slices).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    unit = dealt.select(*where, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key")
    whole = unit.join(vectors, "key")
    order = [*where, "i", "j"]
    dealt = whole.repartition(*order).sortWithinPartitions(*order, "key")

    def run(batches):
        held: list = []
        last = None

        def done(rows):
            i, j = last[3:]
            x = np.array([r["embedding"] for r in rows])
            w = np.array([r["weight"] for r in rows], np.int64)
            got, root = links_of_unit(x, w, np.array([r["side"] for r in rows]), [np.array(r["filters"]) for r in rows], last[2], i == j)
            hit = np.nonzero((got > 0) | (root != np.arange(len(rows))))[0]
            return [rows[k]["key"] for k in hit], got[hit].tolist(), [rows[root[k]]["key"] for k in hit]

        def batch_of(outs):
            k, g, r = (sum((o[c] for o in outs), []) for c in range(3))
            return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(g, pa.int64()), pa.array(r, pa.binary())], names=["key", "links", "root"])

        for batch in batches:
            outs = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in order)
                if key != last:
                    if held:
                        outs.append(done(held))
                    held, last = [], key
                held.append(row)
            if outs:
                yield batch_of(outs)
        if held:
            yield batch_of([done(held)])

    return dealt.mapInArrow(run, "key binary, links long, root binary")


def near_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = materialize(keyed(df, id_col, vector_col, label_col), "vectors")
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least")
    )
    distinct = materialize(distinct, "distinct")
    found = materialize(links(distinct), "links")
    comp = connected_components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = distinct.select("key", "weight", "least").join(total, "key", "left").join(comp.withColumnRenamed("node", "key"), "key", "left")
    info = materialize(info.select("key", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "key").alias("comp")), "classes")
    names = info.groupBy("comp").agg(F.min("least").alias("component_id"))
    info = info.join(names, "comp").select("key", (F.col("weight") - 1 + F.col("links")).alias("n_links"), F.col("component_id").alias("named"))
    out = rows.select("vec_id", "key").join(info, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("named"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force: all pairs of distinct vectors of a label.
ORACLE_SQL = r"""
WITH RECURSIVE
v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS able
  FROM embeddings),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, label, e, len(e) AS dim, sqrt(list_inner_product(e, e)) AS norm, count(*) AS weight, min(vec_id) AS least
  FROM v WHERE able GROUP BY label, e),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, b.weight FROM d a JOIN d b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r
  WHERE CASE WHEN a.dim = b.dim THEN list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.98 END),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a, min(least) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a),
counts AS (SELECT a, CAST(sum(weight) AS BIGINT) AS n FROM links GROUP BY a),
classes AS (
  SELECT label, e, weight - 1 + coalesce(n, 0) AS n_links, CASE WHEN named.a IS NULL THEN least ELSE component_id END AS component_id
  FROM d LEFT JOIN named ON named.a = d.r LEFT JOIN counts ON counts.a = d.r)
SELECT v.vec_id, coalesce(c.n_links, 0) AS n_links, CASE WHEN able THEN c.component_id ELSE v.vec_id END AS component_id,
  coalesce(v.vec_id = CASE WHEN able THEN c.component_id ELSE v.vec_id END, false) AS kept
FROM v LEFT JOIN classes c ON able AND c.label = v.label AND c.e = v.e
"""
