"""Language identification: known words first, then ever shorter n-grams.

Method.  From labelled texts, count words per language.  A word of the table
scores each language by the log of its smoothed relative frequency there.  Any
other word falls back to its character 4-grams, and if none of them is known to
3-grams, 2-grams and single characters; it scores by the mean log frequency of
those known.  A text's score is the sum over its words; the reported score is
the posterior of the best language under equal priors.

Fitting uses a bounded sample: about ``MAX_TRAIN_DOCS`` labelled texts of a
language (those with the least hash), or, with very many languages, ``MAX_TRAIN_ROWS``
in all, but at least ``MIN_TRAIN_DOCS`` of each.  Every word and n-gram of the sample and every
language is learned; the tables hold one number for each language that a word or n-gram
occurs in, as smoothing gives all other languages one and the same.  The sample
of four languages of ``check_s`` (8,000 documents) makes a model of 13 MB, about 60 MB in a worker.  Prediction covers every row and the whole of each text, from
the text alone.

Defined cases: null text or text without a letter is ``und`` with score 0; a
text in which nothing is known, or a model without languages, likewise takes the
first learned language at its prior (``und`` without any); ties go to the
language first in order; rows with a null id or language are not learned from
and a null id counts as not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, pick, texts

#: Labelled rows that the model is fitted on (expected): of a language, in all, and of a language at least.
MAX_TRAIN_DOCS = 2000
MAX_TRAIN_ROWS = 40_000
MIN_TRAIN_DOCS = 50
ORDERS = (4, 3, 2, 1)
SMOOTH = 0.5
CHUNK = 1 << 16  # words gathered at once, so that a very long text needs bounded memory
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word; of order 0, the word itself."""
    if n == 0:
        return [word]
    padded = word if n == 1 else f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Word and n-gram log frequencies per language; picklable.

    ``keys[n]``: word or n-gram -> row.  Row r of the languages ``lang[at[r]:at[r + 1]]``
    has ``more`` above ``base[n]``, the log frequency of what a language never had.
    """

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: (lang, word, n)."""
        total: Counter = Counter()
        for lang, word, c in counts:
            for n in (0, *ORDERS):
                for g in grams(word, n):
                    total[n, g, lang] += c
        cols = list(zip(*((*k, c) for k, c in total.items()))) or [[], [], [], []]
        self._fill(pa.table({k: pa.array(v, t) for k, v, t in zip(("order", "gram", "lang", "n"), cols, (pa.int32(), pa.string(), pa.string(), pa.int64()))}))

    @classmethod
    def of(cls, table: pa.Table) -> Model:
        """Of counts (order, gram, lang, n), each (order, gram, lang) once."""
        model = cls.__new__(cls)
        model._fill(table)
        return model

    def _fill(self, table: pa.Table) -> None:
        table = table.sort_by([("order", "ascending"), ("gram", "ascending"), ("lang", "ascending")]).combine_chunks()
        self.langs: list[str] = sorted(pc.unique(table["lang"]).to_pylist())
        self.lang = pc.index_in(table["lang"], pa.array(self.langs, pa.string())).to_numpy().astype(np.int32)
        n, order = table["n"].to_numpy(), table["order"].to_numpy()
        self.more = np.log(n / SMOOTH + 1)
        self.keys, self.base, at = {}, {}, [np.zeros(0, np.int64)]
        rows = 0
        for k in sorted({0, *ORDERS}):
            lo, hi = np.searchsorted(order, [k, k + 1])
            gram = table["gram"].slice(lo, hi - lo).combine_chunks()
            new = np.ones(hi - lo, bool)
            if hi - lo > 1:
                new[1:] = pc.not_equal(gram.slice(1), gram.slice(0, len(gram) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            self.keys[k] = dict(zip(gram.take(pa.array(first)).to_pylist(), range(rows, rows + len(first))))
            seen = np.bincount(self.lang[lo:hi], weights=n[lo:hi], minlength=len(self.langs))
            self.base[k] = np.log(SMOOTH) - np.log(seen + SMOOTH * max(1, len(first)))
            at.append(lo + first)
            rows += len(first)
        self.at = np.concatenate([*at, [len(n)]]).astype(np.int64)


class Scorer:
    """Predicts with a model: a few array operations a text."""

    def __init__(self, model: Model):
        self.model = model

    def _grams(self, word: str) -> tuple[int, list[int]]:
        """The longest order with known n-grams, and their rows."""
        for n in ORDERS:
            at = self.model.keys[n]
            if known := [at[g] for g in grams(word, n) if g in at]:
                return n, known
        return 0, []

    def _more(self, rows: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Sum over rows of what they have above the base, for each language."""
        m = self.model
        begin, counts = m.at[rows], m.at[rows + 1] - m.at[rows]
        flat = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        more = m.more[flat] if weight is None else m.more[flat] * np.repeat(weight, counts)
        return np.bincount(m.lang[flat], weights=more, minlength=len(m.langs))

    def total(self, found: list[str]) -> np.ndarray:
        """Log likelihood of the words in each language."""
        base, get = self.model.base, self.model.keys[0].get
        total = np.zeros(len(self.model.langs))
        for k in range(0, len(found), CHUNK):
            part = found[k : k + CHUNK]
            rows = np.array([get(w, -1) for w in part], np.int64)
            known = rows[rows >= 0]
            total += len(known) * base[0] + self._more(known)
            if len(known) < len(part):
                flat, counts, orders = [], [], Counter()
                for w, r in zip(part, rows.tolist()):
                    if r < 0:
                        n, g = self._grams(w)
                        if g:
                            flat += g
                            counts.append(len(g))
                            orders[n] += 1
                counts = np.array(counts, np.int64)
                total += self._more(np.array(flat, np.int64), np.repeat(1 / np.maximum(counts, 1), counts))
                for n, c in orders.items():
                    total += c * base[n]
        return total

    def __call__(self, text: str) -> tuple[str, float]:
        found = words(text)
        if not self.model.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        total = self.total(found)
        best = int(np.argmax(total))
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Fit on the rows of ``df`` that have text and a language; ``key_col`` only picks the sample."""
    rows = pick(df, text=text_col, lang=lang_col, key=key_col).where("text IS NOT NULL AND lang IS NOT NULL AND key IS NOT NULL").withColumn("lang", F.col("lang").cast("string"))
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    docs = max(MIN_TRAIN_DOCS, min(MAX_TRAIN_DOCS, MAX_TRAIN_ROWS // max(1, sizes.count())))
    span = 1 << 30
    # an order of its own for the sample, so that rows close in id do not fall in or out together
    at = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(span))
    sample = rows.join(sizes, "lang").where(at.cast("double") * F.col("docs") < float(span * docs)).select("lang", "text")

    def start():
        def f(batch):
            got: Counter = Counter()
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                by_lang.setdefault(lang, Counter()).update(words(text))
            for lang, seen in by_lang.items():
                for w, c in seen.items():
                    for n in (0, *ORDERS):
                        for g in grams(w, n):
                            got[n, g, lang] += c
            return [list(c) for c in zip(*((*k, c) for k, c in got.items()))] or [[], [], [], []]

        return f

    counts = arrow_map(sample, "order int, gram string, lang string, n long", start).groupBy("order", "gram", "lang").agg(F.sum("n").alias("n"))
    return Model.of(counts.toArrow())  # of the sample alone


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """Columns ``keep`` (alias -> column), lang_pred and score for every row."""
    keep = keep or {"doc_id": "doc_id"}
    kinds = {a: df.schema[c].dataType.simpleString() for a, c in keep.items()}
    shared = df.sparkSession.sparkContext.broadcast(model)  # of the bounded sample

    def start():
        score = Scorer(shared.value)

        def f(batch):
            got = [score(t) for t in texts(batch, "_text")]
            return [batch.column(a) for a in kinds] + [[g[0] for g in got], [g[1] for g in got]]

        return f

    schema = ", ".join([f"`{a}` {k}" for a, k in kinds.items()] + ["lang_pred string", "score double"])
    return arrow_map(pick(df, **keep, _text=text_col), schema, start)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
