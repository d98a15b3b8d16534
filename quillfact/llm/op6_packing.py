"""Mixture-controlled packing: deficit round-robin over source queues.

Method.  Every source is a queue of tokens; every window of ``WINDOW`` tokens
gives each queue a quantum in proportion to its target share (stated, or its tokens
to the power ``ALPHA``, which raises small sources), and what a queue
could not be given exactly (a fraction of a token, or a turn it had to wait) is
its deficit, carried to the next window.  With cuts allowed anywhere this
schedule has a closed form: the j-th token of queue s falls due at
(j + 1/2) / share_s, all tokens are served in the order they fall due, and the
queue's deficit after w windows is its due tokens less its served tokens, under
two tokens while the queue lasts (the tests run a plain round-robin beside it); a queue that is empty gets nothing and
the others share its part.  ``served`` computes a queue's position after any
window directly, so a task starts with the deficits that all windows before its
own have left, whichever partition they were filled in.

Steps: each task tokenises its documents and numbers their tokens within
(task, source), written with the ids to the shared folder; sums per
(task, source), a small table, become global queue positions by one window
function per queue; then each document is cut where the windows say.  Nothing of
the size of the corpus is sorted or collected.

Every source has a queue.  More than ``QUEUES`` of them form a tree: a schedule
over blocks of queues, whose share is the sum of theirs, says how many tokens of a
block each window gets, and the block's own schedule goes on from there in the same
closed form, so a window costs a task ``QUEUES`` numbers a level.  A level adds less than a token to the deficit.
What a task holds is one number a source.  Sources with a target share are not in
the tree: each has its queue in one schedule, and the rest follows when they are
served.  Full windows have no padding; the last, partial one is cut into sequences
whose lengths are powers of two, which need none either.

Defined cases: null text is empty and still has its end token; a null source is
a source of its own; repeated rows are packed as rows of their own; an empty
table gives an empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, pick, texts
from .op2_bpe import byte_alphabet

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1
WINDOW = 2048
#: A source's target share is its tokens to this power, over the sum of all.
ALPHA = 0.7
#: Queues of one schedule of the tree.
QUEUES = 64
#: Numbers in one array of window positions.
CELLS = 1 << 20


class Tokenizer:
    """ids of a byte-level BPE file as the tokenizers library gives them.

    Texts of Latin characters without added tokens go through tiktoken, loaded
    from the same file's vocabulary and the same splitting pattern, which makes
    the same ids several times faster (the tests compare them); all other texts
    go through the library itself, whose character classes may be of another
    Unicode version.  That the file's merges are in the order of its ids, which
    ranks need, is checked on loading; otherwise the library does everything.
    """

    def __init__(self, path: str = TOKENIZER):
        import tiktoken
        from tokenizers import Tokenizer as T

        self.lib = T.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, byte = model["vocab"], {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        made = [vocab["".join(m)] for m in model["merges"]]
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.other = re.compile("[^\x00-\u024f]|" + "|".join(map(re.escape, added)) if added else "[^\x00-\u024f]")
        self.fast = None
        if made == list(range(256, 256 + len(made))) and sorted(vocab[c] for c in byte) == list(range(256)):
            ranks = {b"".join([byte[c] for c in s]): i for s, i in vocab.items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 16-bit integers."""
        if self.fast is None or self.other.search(text):
            ids = self.lib.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("H", ids).tobytes()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str = TOKENIZER) -> Tokenizer:
    """A worker's tokenizer, loaded once for all its tasks."""
    return Tokenizer(path)


def tokenized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, part, at, n, ids): at counts tokens within (part, source); ids end with END_ID."""

    def start():
        encode, at, end = tokenizer(path), {}, np.array([END_ID], "<u2").tobytes()
        part = TaskContext.get().partitionId()

        def f(batch):
            ids = [encode(t) + end for t in texts(batch)]
            where = []
            for s, x in zip(batch.column("source").to_pylist(), ids):
                where.append(at.get(s, 0))
                at[s] = where[-1] + len(x) // 2
            return [batch.column("doc_id"), batch.column("source"), [part] * len(ids), where, [len(x) // 2 for x in ids], ids]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    got = pick(df, doc_id=id_col, text=text_col, source=source_col).withColumn("source", F.col("source").cast("string"))
    return arrow_map(got, f"doc_id {kind}, source string, part int, at long, n long, ids binary", start)


class Schedule:
    """The deficit round-robin over queues of ``sizes`` tokens with ``shares``."""

    def __init__(self, sizes, shares=None):
        self.n = np.array(sizes, np.float64)
        p = np.array(self.n if shares is None else shares, np.float64)
        if (p <= 0).any():
            raise ValueError("a queue of a schedule needs a share; those without one wait for another schedule")
        self.p = p / max(p.sum(), 1e-300)
        self.total = int(self.n.sum())
        self.windows = -(-self.total // WINDOW)

    def _due(self, t: np.ndarray) -> np.ndarray:
        """Tokens of each queue that have fallen due by the times t."""
        return np.minimum(self.n, np.floor(t[:, None] * self.p + 0.5))

    def served(self, w: np.ndarray) -> np.ndarray:
        """Tokens of each queue served in the first w windows (rows: w)."""
        return self._after(np.minimum(np.asarray(w, np.float64) * WINDOW, self.total))

    def _after(self, want: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first ``want`` served."""
        low, high = np.zeros(len(want)), np.full(len(want), ((self.n + 1) / self.p).max(initial=1.0))
        open_ = np.arange(len(want))  # each row is halved until its own bracket is small: the result depends on w alone
        for _ in range(80):
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) / 2
            few = self._due(mid).sum(1) < want[open_]
            low[open_] = np.where(few, mid, low[open_])
            high[open_] = np.where(few, high[open_], mid)
            wide = (self._due(high[open_]) - self._due(low[open_])).max(1, initial=0) > 1
            open_ = open_[wide]
        done = self._due(low)
        more = self._due(high) - done
        before = np.cumsum(more, 1) - more
        return (done + np.clip((want - done.sum(1))[:, None] - before, 0, more)).astype(np.int64)

    def window_of(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window that serves token ``at`` of queue ``q``."""
        t = (at + 0.5) / self.p[q]
        w = np.clip(self._due(t).sum(1).astype(np.int64) // WINDOW, 0, max(0, self.windows - 1))
        rows = np.arange(len(q))
        while True:
            uniq, inv = np.unique(np.concatenate([w, w + 1]), return_inverse=True)
            c = self.served(uniq)
            lo, hi = c[inv[: len(w)], q[rows]], c[inv[len(w) :], q[rows]]
            step = np.where(at < lo, -1, np.where(at >= hi, 1, 0))
            if not step.any():
                return w
            w = w + step

    def at(self, want: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of queue ``q``, and of all queues before it, among the first ``want`` served."""
        uniq, inv = np.unique(want, return_inverse=True)
        mine, before, rows = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), max(1, CELLS // max(1, len(self.n)))
        for k in range(0, len(uniq), rows):
            here = np.flatnonzero((inv >= k) & (inv < k + rows))
            c = self._after(uniq[k : k + rows].astype(np.float64))
            mine[here] = c[inv[here] - k, q[here]]
            before[here] = (np.cumsum(c, 1) - c)[inv[here] - k, q[here]]
        return mine, before

    def rank(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """About how many tokens are served before token ``at`` of queue ``q``."""
        out, rows = np.zeros(len(q), np.int64), max(1, CELLS // max(1, len(self.n)))
        for k in range(0, len(q), rows):
            out[k : k + rows] = self._due((at[k : k + rows] + 0.5) / self.p[q[k : k + rows]]).sum(1)
        return out


class Tree:
    """Schedules over any number of queues in proportion to ``shares``, by default their sizes."""

    def __init__(self, sizes, shares=None):
        self.sizes, self.block = np.array(sizes, np.int64), None
        self.shares = np.array(self.sizes if shares is None else shares, np.float64)
        if len(self.sizes) > QUEUES:
            first = np.arange(0, len(self.sizes), QUEUES)
            self.above = Tree(np.add.reduceat(self.sizes, first), np.add.reduceat(self.shares, first))
            self.block = QUEUES
            self.below: dict[int, Schedule] = {}
        else:
            self.only = Schedule(self.sizes, self.shares)

    def _blocks(self, q: np.ndarray):
        """(schedule of a block, rows of ``q`` in it)"""
        for b in np.unique(q // self.block).tolist():
            if b not in self.below:
                part = slice(b * self.block, (b + 1) * self.block)
                self.below[b] = Schedule(self.sizes[part], self.shares[part])
            yield self.below[b], np.flatnonzero(q // self.block == b)

    def at(self, want: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.block is None:
            return self.only.at(want, q)
        given, before = self.above.at(want, q // self.block)
        mine = np.zeros_like(given)
        for schedule, rows in self._blocks(q):
            mine[rows], ahead = schedule.at(given[rows], q[rows] % self.block)
            before[rows] += ahead
        return mine, before

    def rank(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.block is None:
            return self.only.rank(q, at)
        inner = np.zeros(len(q), np.int64)
        for schedule, rows in self._blocks(q):
            inner[rows] = schedule.rank(q[rows] % self.block, at[rows])
        return self.above.rank(q // self.block, inner)


class Mixture:
    """Queues with target ``shares`` first, as one schedule, then all others by size to the power ``alpha``."""

    def __init__(self, sizes, shares=(), alpha: float = 1.0):
        self.named, self.total = len(shares), int(sum(sizes))
        self.split = int(sum(sizes[: self.named]))
        self.windows = -(-self.total // WINDOW)
        self.parts = [Schedule(sizes[: self.named], shares), Tree(sizes[self.named :], np.array(sizes[self.named :], np.float64) ** alpha)]

    def _parts(self, q: np.ndarray):
        """(part, its rows, its queues, tokens of the parts before it, its tokens)"""
        for part, mine, low, skip, n in ((self.parts[0], q < self.named, 0, 0, self.split), (self.parts[1], q >= self.named, self.named, self.split, self.total - self.split)):
            if mine.any():
                yield part, np.flatnonzero(mine), q[mine] - low, skip, n

    def at(self, w: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of queue ``q``, and of all queues before it, served in the first w windows."""
        want = np.minimum(np.asarray(w, np.int64) * WINDOW, self.total)
        mine, before = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for part, rows, queue, skip, n in self._parts(q):
            mine[rows], ahead = part.at(np.clip(want[rows] - skip, 0, n), queue)
            before[rows] = ahead + np.minimum(want[rows], skip)
        return mine, before

    def window_of(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window that serves token ``at`` of queue ``q``."""
        w = np.zeros(len(q), np.int64)
        for part, rows, queue, skip, _ in self._parts(q):
            w[rows] = (part.rank(queue, at[rows]) + skip) // WINDOW
        w = np.clip(w, 0, max(0, self.windows - 1))
        while True:
            c, _ = self.at(np.concatenate([w, w + 1]), np.concatenate([q, q]))
            step = np.where(at < c[: len(w)], -1, np.where(at >= c[len(w) :], 1, 0))
            if not step.any():
                return w
            w = w + step


def last_sequences(rest: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two sequences that hold the last ``rest`` tokens."""
    out, at = [], 0
    while at < rest:
        size = 1 << ((rest - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def cut(schedule: Mixture, q: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Pieces of documents at queue positions: (row, start, length, sequence_id, offset)."""
    first, last = schedule.window_of(q, at), schedule.window_of(q, at + n - 1)
    counts = last - first + 1
    row = np.repeat(np.arange(len(q)), counts)
    w = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    queue = q[row]
    c, before = schedule.at(np.concatenate([w, w + 1]), np.concatenate([queue, queue]))
    lo, hi = c[: len(w)], c[len(w) :]
    ahead = before[len(w) :] - before[: len(w)]
    start = np.maximum(at[row], lo)
    length = np.minimum((at + n)[row], hi) - start
    offset = ahead + start - lo
    out = [row, start - at[row], length, w.copy(), offset]
    full = schedule.total // WINDOW
    tail = (w == full) & (length > 0)
    keep = (length > 0) & ~tail
    parts = [[x[keep] for x in out]]
    for s, (a, size) in enumerate(last_sequences(schedule.total - full * WINDOW)):
        b, e = np.maximum(offset[tail], a), np.minimum(offset[tail] + length[tail], a + size)
        hit = b < e
        parts.append([row[tail][hit], (start - at[row] - offset)[tail][hit] + b[hit], (e - b)[hit], np.full(hit.sum(), full + s), b[hit] - a])
    row, *rest = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((rest[0], row))
    return [row[order], *[x[order] for x in rest]]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: dict | None = None, alpha: float = ALPHA, path: str = TOKENIZER) -> DataFrame:
    """Pieces: doc_id, start, length, ids (uint16 little-endian), doc_tokens, sequence_id, offset, source.

    ``shares`` maps sources to target proportions; others, and those whose share is
    not above zero, get none until these are served.  Sources without a stated share
    have their tokens to the power ``alpha`` as theirs (1: the corpus's own mixture).
    """
    docs = materialize(tokenized(df, id_col, text_col, source_col, path), "tokens")
    sums = materialize(docs.groupBy("part", "source").agg(F.sum("n").alias("tokens")), "sums")
    found = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()
    target = {s: p for s, p in (shares or {}).items() if p > 0}
    found.sort(key=lambda r: (r["source"] not in target, -r["tokens"], r["source"] is None, r["source"] or ""))
    schedule = Mixture([r["tokens"] for r in found], [target[r["source"]] for r in found if r["source"] in target], alpha)
    queues = df.sparkSession.createDataFrame([(r["source"], k) for k, r in enumerate(found)], "name string, queue int")
    queues = materialize(queues.coalesce(1), "queues")
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.join(queues, F.col("source").eqNullSafe(F.col("name"))).withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    bases = materialize(bases.select("part", F.col("source").alias("src"), "queue", "base"), "bases")
    placed = docs.join(bases, (docs["part"] == bases["part"]) & docs["source"].eqNullSafe(bases["src"])).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        def f(batch):
            if not batch.num_rows:
                return [[]] * 8
            q, at, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "at", "n"))
            row, s, length, seq, offset = cut(schedule, q, at, n)
            ids = batch.column("ids").to_pylist()
            take = pa.array(row)
            pieces = [ids[r][2 * a : 2 * (a + m)] for r, a, m in zip(row.tolist(), s.tolist(), length.tolist())]
            return [batch.column("doc_id").take(take), pa.array(s), pa.array(length), pieces, batch.column("n").take(take), pa.array(seq), pa.array(offset), batch.column("source").take(take)]

        return f

    return arrow_map(placed, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string", start)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (of the ids as unsigned 32-bit integers) instead of the ids."""
    fields = [f for f in pieces.schema.fields if f.name != "ids"]

    def start():
        def f(batch):
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            return [batch.column(c.name) for c in fields] + [crc]

        return f

    return arrow_map(pieces, ", ".join([f"{c.name} {c.dataType.simpleString()}" for c in fields] + ["ids_crc32 long"]), start)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
