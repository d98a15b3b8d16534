"""Corpus pipeline: language ID, quality rules, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage as Parquet in the shared folder and reads it again.

* language ID: documents without a letter (``und``) or whose best language has a
  posterior under ``MIN_LANGUAGE_SCORE`` go; ``lang`` of the rest is the
  predicted language where it was null.
* quality rules: documents that fail the base rule or the learned list go.
* near-dedup: one row of each class stays, that with the least id; of several
  rows of that id in the class, any one.
* secret scans: found spans are replaced by a marker; ``n_chars`` follows.
* packing: token pieces of at most 2048, their ids as unsigned 16-bit integers.

Rows with a null id are kept by the first two stages and the scan; near-dedup
keeps one only in a class of null ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.llm import op3_simhash, op4_langid, op6_packing, op7_secrets, op8_quality
from quillfact.llm.common import materialize, sized

MIN_LANGUAGE_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_ALL = {f"in_{c}": c for c in COLUMNS}

#: No stage can be told in SQL as a whole: two learn models, one hashes with
#: XXH64 and one runs a tokenizer.
ORACLE_SQL = None


def _documents(df: DataFrame, **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col(f"in_{c}")).alias(c) for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op4_langid.train(docs)
    out = op4_langid.identify(docs, model, keep=_ALL)
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _documents(out, lang=F.coalesce("in_lang", "lang_pred"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = op8_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(op8_quality.judge(docs, rules, keep=_ALL).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # equal rows have one key; where a null stands is part of it, as xxhash64 passes over nulls
    keyed = docs.withColumn("_row", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    marked = materialize(op3_simhash.near_dedup(keyed, row_col="_row"), "marked")
    # Tables of keys against the documents: written first, so that their size is
    # known, and they are broadcast if small instead of moving the texts.
    key = [F.col("doc_id").alias("id"), F.col("row")]
    goes = materialize(marked.where("NOT stands").select(*key).distinct(), "goes")
    twice = materialize(marked.where("stands").select(*key).groupBy("id", "row").count().where("count > 1").select("id", "row"), "twice")

    def join(keys, how):
        return keyed.join(sized(keys, keys.count()), (F.col("_row") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), how)

    once = join(goes.union(twice), "left_anti")
    again = join(twice, "left_semi").dropDuplicates(["doc_id", "_row"])
    return once.unionByName(again).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op7_secrets.scan(docs, keep=_ALL)
    text = F.when(F.size("spans") > 0, F.col("redacted")).otherwise(F.col("in_text"))
    chars = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("in_n_chars"))
    return _documents(out, text=text, n_chars=chars)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
