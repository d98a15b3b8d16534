"""Quality rules: a decision list learned by sequential covering.

Method.  Labelled documents give rows of text statistics.  Rules for the class
"reject" are grown one after another: a rule is a conjunction of threshold
conditions, extended greedily by FOIL gain on two thirds of the rows not yet
covered, then pruned from its end on the other third by (p - n) / (p + n).  A
rule is accepted if its precision on the held part reaches ``MIN_PRECISION``;
what it covers is removed and the next is grown.  The ordered list is emitted
as one Spark conditional expression over the statistics, so applying it is a
plain projection.

Nothing but gain, pruning and precision ends a rule or the list.

Fitting uses at most ``MAX_TRAIN`` labelled rows (those with the least hash of
their id; of several texts of one id, that with the least statistics); statistics
and verdicts cover every row and the whole of each text.  Texts are read in pieces
and words kept as 64-bit hashes, so that a text of any length needs some 60 bytes a
word at most.

Defined cases: null text counts as empty and fails the base rule; labels that
are null are ignored, contradicting labels of one id are decided by majority
and dropped on a tie; without labels of both classes the list is empty and
keeps everything the base rule keeps; repeated rows are judged alike; an empty
table gives an empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, pick, texts

#: Labelled rows that the list is fitted on, at most.
MAX_TRAIN = 20_000
MIN_PRECISION = 0.97
MIN_COVER = 5
WINDOW_WORDS = 5
SYMBOLS = "#*$%&|<>"
PIECE = 1 << 20  # bytes of a text split into words or lines at once

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_stops", "n_distinct"]

SPACE = re.compile(rb"[\x20\x09-\x0d]")
LINE_END = re.compile(rb"\n")

#: Threshold features as SQL over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeat_words(words: np.ndarray) -> int:
    """Words, given by their hashes, that lie in a window of five found at least twice in the text."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW_WORDS):
        window = window * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW_WORDS):
        covered[k : k + n] |= twice
    return int(covered.sum())


def _pieces(raw: bytes, end: re.Pattern):
    """The bytes in pieces of about ``PIECE``, each ending with a match of ``end``."""
    at = 0
    while at < len(raw):
        m = end.search(raw, at + PIECE)
        to = m.end() if m else len(raw)
        yield raw[at:to]
        at = to


def text_stats(text: str) -> tuple:
    """The values of ``STATS`` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    # bytes split on space and \x09-\x0d only
    words = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(hash, part.split()), np.int64) for part in _pieces(raw, SPACE)]]).view(np.uint64)
    seen, lines = set(), 0
    for part in _pieces(raw, LINE_END):
        for line in (part[:-1] if part.endswith(b"\n") else part).split(b"\n"):
            if line.strip():
                lines += 1
                seen.add(hash(line))
    count = lambda chars: int(sum(by[ord(c)] for c in chars))
    return (
        len(words), len(text) - int(by[9:14].sum() + by[32]), count(SYMBOLS), lines - len(seen), repeat_words(words),
        lines, int(by[65:91].sum()), int(by[48:58].sum()), count("!"), count(".?"), len(np.unique(words)),
    )


def stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """Columns ``keep`` (alias -> column; the id by default) and ``STATS``."""
    keep = keep or {"doc_id": id_col}
    kinds = {a: df.schema[c].dataType.simpleString() for a, c in keep.items()}

    def start():
        def f(batch):
            rows = [text_stats(t) for t in texts(batch, "_text")]
            return [batch.column(a) for a in kinds] + [list(c) for c in zip(*rows)] if rows else [batch.column(a) for a in kinds] + [[] for _ in STATS]

        return f

    schema = ", ".join([f"`{a}` {k}" for a, k in kinds.items()] + [f"{s} long" for s in STATS])
    return arrow_map(pick(df, **keep, _text=text_col), schema, start)


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > value, else feature <= value
    value: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.value!r}D"


def _best(x, y, rows, features) -> tuple[float, Condition | None]:
    """The condition of greatest FOIL gain on ``rows`` (y true: to reject)."""
    p0, n0 = int(y[rows].sum()), int((~y[rows]).sum())
    best, found = 1e-9, None
    if not p0 or not n0:
        return best, None
    before = np.log2(p0 / (p0 + n0))
    for name in features:
        v = x[name][rows]
        order = np.argsort(v, kind="stable")
        sv, sy = v[order], y[rows][order]
        cut = np.nonzero(sv[1:] > sv[:-1])[0]
        if not len(cut):
            continue
        pl, tl = np.cumsum(sy)[cut], cut + 1
        for above, p, t in ((False, pl, tl), (True, p0 - pl, len(rows) - tl)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / t) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float((sv[cut[k]] + sv[cut[k] + 1]) / 2))
    return best, found


def _all(conds, x, n) -> np.ndarray:
    out = np.ones(n, bool)
    for c in conds:
        out &= c.covers(x)
    return out


def learn(x: dict[str, np.ndarray], reject: np.ndarray, fold: np.ndarray) -> list[list[Condition]]:
    """Ordered conjunctions for rejection.  ``fold`` true: rows that prune."""
    n, left, rules, features = len(reject), np.ones(len(reject), bool), [], list(x)
    while True:
        rows, conds = np.nonzero(left & ~fold)[0], []
        while reject[rows].any() and not reject[rows].all():
            _, c = _best(x, reject, rows, features)
            if c is None:
                break
            conds.append(c)
            rows = rows[c.covers({k: v[rows] for k, v in x.items()})]
        if not conds:
            break
        held = left & fold

        def worth(k):
            got = _all(conds[:k], x, n) & held
            p, q = int((got & reject).sum()), int((got & ~reject).sum())
            return (p - q) / (p + q) if p + q else -1.0, -k

        conds = conds[: max(range(1, len(conds) + 1), key=worth)]
        got = _all(conds, x, n) & left
        right = int((got & reject).sum())
        tested = got & fold if (got & fold).sum() >= MIN_COVER else got
        if right < MIN_COVER or (tested & reject).sum() < MIN_PRECISION * tested.sum():
            break
        rules.append(conds)
        left &= ~got
    return rules


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """Learn the list from the documents that ``labels`` (doc_id, quality) covers."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q <> 0.5")
    sample = one.select("doc_id", (F.col("q") < 0.5).alias("reject")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    docs = pick(df, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL")
    # at most MAX_TRAIN rows of an id and a flag: a proven bound
    labelled = docs.join(F.broadcast(sample), "doc_id")
    got = stats(labelled, keep={"doc_id": "doc_id", "reject": "reject"}).where(~base_failed())
    row = F.struct(*[F.expr(s).alias(f) for f, s in FEATURES.items()], "reject")
    # one row an id, so MAX_TRAIN at most, and the same whatever the order of rows
    rows = got.groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*").orderBy("doc_id").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in rows["doc_id"]], bool)
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["reject"].to_numpy(bool), fold)


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered list as a conditional expression: number of the rule that rejects, 0 if none."""
    out = None
    for k, conds in enumerate(rules, 1):
        test = F.expr(" AND ".join(c.sql() for c in conds))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(df: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """Statistics, base_failed, rule (number of the rule that rejects, or 0) and kept for every row."""
    return stats(df, id_col, text_col, keep).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_quality_rules`` that SQL can tell: all but the learned list's verdict."""
    got = stats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("base_failed", base_failed())
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS five(k) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""
