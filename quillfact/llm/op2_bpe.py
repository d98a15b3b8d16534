"""BPE by a tokenization automaton.

Method.  The merges, in order, are compiled into a deterministic automaton over
tokens that accepts exactly the token sequences BPE makes.  It begins with one
state, in which every base symbol loops.  The gadget for a merge (u, v) -> w
splits a new state off the state after v, takes the arc v away from the state
after u, and gives an arc w, leading to the new state, to every state that has an
arc u.  All arcs with one label lead to one state, so a state is the label read
last.  Each gadget is compiled into stored arcs as differences (written out, the
arcs of 48,894 merges would take gigabytes):

* ``parent``, ``since``: the state that a state was split off, and the step: what
  the parent had just before is the copy's too;
* ``lost``: an arc taken from a state, with the step;
* ``gain``: label w comes to all states that have label u at w's step.

Labels consist of symbols, so the arcs are then joined with a table of the labels'
symbols into one over symbols: a place in it is the set of (state, symbols read of a
label that may follow), and reading a symbol moves all of them on.  Every prefix of a
word has exactly one accepted token sequence, so exactly one state is reached with each
symbol.  Places and their transitions are made when first met and stored; a word is
encoded by one look into the table a symbol, from its first to its last.  No merge loop
runs at encoding time.  Decoding emits the labels of the arcs.

Pre-splitting, normalisation, added tokens and the joining of labels are those
of the tokenizer file (NFC, white space, lower case; a decoder that joins with
one space).  Normalising and splitting of other than ASCII characters is left to
the library's own parts, so that its Unicode version counts, not Python's.  As no
rule of the file looks across white space, words between white space are encoded
one by one and remembered.

Defined cases: null or empty text has no ids and decodes to the empty text;
texts of any length are encoded whole; repeated rows alike; an empty table gives
an empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import arrow_map, pick, texts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHE = 300_000  # words remembered by a worker; beyond it the memory is emptied
PLACES = 400_000  # places of the table over symbols, likewise
KEPT = 100  # characters of the longest word that is remembered
SPACE = regex.compile(r"\s+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")  # str.split takes these for white space, the expression doesn't


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    """The deterministic automaton of an ordered list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = self.n = max(vocab.values()) + 1
        self.parent, self.since, self.gain = [-1] * n, [0] * n, [-1] * n
        #: state * n + label -> step of the gadget that took the arc away
        self.lost: dict[int, int] = {}
        #: whether a label leads anywhere: a merge whose pair never occurs makes none
        self.alive = [False] * n
        self.spelling: list[tuple[str, ...]] = [()] * n
        made = {u + v for u, v in merges}
        for s, i in vocab.items():
            if s not in made:
                self.alive[i], self.spelling[i] = True, (s,)
        for step, (u, v) in enumerate(merges, 1):
            self._gadget(step, vocab[u], vocab[v], vocab[u + v])
        self.length = [len(x) for x in self.spelling]
        #: node of the labels' symbols -> symbol -> (token or -1, node)
        self.nodes: list[dict[str, tuple[int, int]]] = [{}]
        for t, spelling in enumerate(self.spelling):
            if self.alive[t]:
                self._spell(t, spelling)
        self.clear()

    def clear(self) -> None:
        """Forget the places and arcs met so far."""
        self.arcs: dict[int, bool] = {}
        #: place -> (state, node) pairs; symbol -> place; the state reached with its last symbol
        self.pairs: list[tuple] = [((-1, 0),)]
        self.table: list[dict[str, int]] = [{}]
        self.reached: list[int] = [-1]
        self.place: dict[tuple, int] = {self.pairs[0]: 0}
        self.ends: list[dict[str, int]] = [{}]

    def _spell(self, t: int, spelling: tuple[str, ...]) -> None:
        nodes, at = self.nodes, 0
        for k, s in enumerate(spelling):
            token, after = nodes[at].get(s, (-1, 0))
            last = k == len(spelling) - 1
            if not after and not last:
                nodes.append({})
                after = len(nodes) - 1
            nodes[at][s] = (t if last else token, after)
            at = after

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        if self.since[w]:
            raise ValueError("two merges make one label; a state would not be told by its last label")
        if not self.spelling[u] or not self.spelling[v]:
            raise ValueError("a label is merged before it is made")
        self.alive[w] = self.alive[u] and self.alive[v] and self._has(u, v, step - 1)
        self.parent[w], self.since[w], self.gain[w] = v, step, u
        self.lost[u * self.n + v] = step
        self.spelling[w] = self.spelling[u] + self.spelling[v]

    def arc(self, state: int, label: int) -> bool:
        """Whether the automaton has this arc (the first state, -1, has all)."""
        if state < 0:
            return True
        key = state * self.n + label
        if (got := self.arcs.get(key)) is None:
            got = self.arcs[key] = self.alive[state] and self.alive[label] and self._has(state, label, 1 << 60)
        return got

    def _has(self, state: int, label: int, step: int) -> bool:
        """The same after the first ``step`` gadgets, read off the differences."""
        since, lost, n = self.since, self.lost, self.n
        while True:
            if lost.get(state * n + label, 1 << 61) <= step:
                return False
            if not since[state] and not since[label]:
                return True
            if since[label] >= since[state]:  # the state gained the label if it then had the one that brought it
                label, step = self.gain[label], since[label]
            else:  # the state is a copy of its parent as that was before the split
                state, step = self.parent[state], since[state] - 1

    def _token(self, place: int, symbol: str) -> int:
        """The one label that ends with this symbol after the place."""
        for state, node in self.pairs[place]:
            t = self.nodes[node].get(symbol, (-1, 0))[0]
            if t >= 0 and self.arc(state, t):
                return t
        raise ValueError(f"no base symbol {symbol!r}")

    def _move(self, place: int, symbol: str) -> int:
        """The place after one more symbol, made if it is new."""
        token = self._token(place, symbol)
        on = [(state, after) for state, node in self.pairs[place] if (after := self.nodes[node].get(symbol, (-1, 0))[1])]
        pairs = (*on, (token, 0))
        if (to := self.place.get(pairs)) is None:
            to = self.place[pairs] = len(self.pairs)
            self.pairs.append(pairs)
            self.table.append({})
            self.ends.append({})
            self.reached.append(token)
        self.table[place][symbol] = to
        return to

    def encode(self, symbols: str, last: str) -> list[int]:
        """Token ids of a word: base symbols of one character each, and its last symbol."""
        table, reached, place, states = self.table, self.reached, 0, []
        for s in symbols:
            to = table[place].get(s)
            if to is None:
                to = self._move(place, s)
            place = to
            states.append(reached[place])
        t = self.ends[place].get(last)
        if t is None:
            t = self.ends[place][last] = self._token(place, last)
        length, out = self.length, [t]
        at = len(states) - length[t]
        while at >= 0:
            t = states[at]
            out.append(t)
            at -= length[t]
        return out[::-1]


class Codec:
    """encode and decode of one tokenizer file; one per worker."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.automaton = Automaton(self.vocab, [tuple(m) for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(words)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.split = pre_tokenizers.Split(Regex(words), "removed", invert=True).pre_tokenize_str
        self.label: list[str | None] = [None] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for s, i in self.vocab.items():
            self.label[i] = s
        for s, i in self.added.items():
            self.label[i] = s
        self.byte = byte_alphabet()
        self.memory: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (got := self.known.get(word)) is None:
            if len(self.automaton.table) > PLACES:
                self.automaton.clear()
            symbols = word if word.isascii() and word.isprintable() else "".join([self.byte[b] for b in word.encode("utf-8", "surrogatepass")])
            got = array("I", self.automaton.encode(symbols[:-1], symbols[-1] + self.suffix)).tobytes()
            if len(word) <= KEPT:
                self.known[word] = got
        return got

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a stretch without white space."""
        if chunk.isascii():
            words = self.words.findall(chunk.lower())
        else:
            words = [w for w, _ in self.split(self.normal(chunk))]
        return b"".join([self._word(w) for w in words])

    def _plain(self, text: str) -> list[bytes]:
        for kept in (self.memory, self.known):
            if len(kept) > CACHE:
                kept.clear()
        memory, out = self.memory, []
        for chunk in SPACE.split(text) if ODD_SPACE.search(text) else text.split():
            if (got := memory.get(chunk)) is None:
                got = self._spaced(chunk)
                if len(chunk) <= KEPT:
                    memory[chunk] = got
            out.append(got)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [array("I", [self.added[part]]).tobytes()] if k % 2 else self._plain(part)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The labels of the ids, joined with one space; unknown ids are left out."""
        label, n = self.label, len(self.label)
        if isinstance(ids, np.ndarray) and (not len(ids) or ids.max() < n):
            try:
                return " ".join(map(label.__getitem__, ids.tolist()))
            except TypeError:  # an id without a label
                pass
        return " ".join([s for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids) if 0 <= i < n and (s := label[i]) is not None])


@functools.lru_cache(maxsize=2)
def codec(path: str = TOKENIZER) -> Codec:
    """A worker's codec, compiled once for all its tasks."""
    return Codec(path)


def encode(df: DataFrame, text_col: str = "text", keep: dict | None = None, path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` (alias -> column) and ids, an array of integers, for every row."""
    keep = keep or {"doc_id": "doc_id"}
    kinds = {a: df.schema[c].dataType.simpleString() for a, c in keep.items()}

    def start():
        c = codec(path)

        def f(batch):
            return [batch.column(a) for a in kinds] + [[c.encode(t).astype(np.int32) for t in texts(batch, "_text")]]

        return f

    return arrow_map(pick(df, **keep, _text=text_col), ", ".join([f"`{a}` {k}" for a, k in kinds.items()] + ["ids array<int>"]), start)


def decode(df: DataFrame, ids_col: str = "ids", keep: dict | None = None, path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` (alias -> column) and decoded, the text of the ids (null: empty)."""
    keep = keep or {"doc_id": "doc_id"}
    kinds = {a: df.schema[c].dataType.simpleString() for a, c in keep.items()}

    def start():
        c = codec(path)

        def f(batch):
            return [batch.column(a) for a in kinds] + [[c.decode(i or []) for i in batch.column("_ids").to_pylist()]]

        return f

    return arrow_map(pick(df, **keep, _ids=ids_col), ", ".join([f"`{a}` {k}" for a, k in kinds.items()] + ["decoded string"]), start)


def roundtrip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Encode, then decode the ids, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        c = codec(path)

        def f(batch):
            ids = [c.encode(t) for t in texts(batch)]
            return [
                batch.column("doc_id"), [len(i) for i in ids],
                [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                [hashlib.sha256(c.decode(i).encode("utf-8", "surrogatepass")).hexdigest() for i in ids],
            ]

        return f

    return arrow_map(pick(df, doc_id=id_col, text=text_col), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", start)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
