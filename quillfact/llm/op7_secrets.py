"""Secret scans: keyword prefilter, anchored expressions, checksum validation.

Method.  One Aho-Corasick automaton per worker finds keywords in the
lower-cased text: the key names of assignments, fixed token prefixes, and all
four-digit hexadecimal strings (a run of 24 has one at its start).  Only at a
hit is the expression of its kind matched, anchored there.  A match that begins
before the end of the previous match of its kind is passed over, which makes
the result that of a leftmost, non-overlapping search of the whole text.
Tokens that embed a checksum are then validated by it.

Kinds, in the order of ties: the base kinds ``assign``, ``access``, ``hex``;
added ones ``github`` and ``npm`` (prefix, 30 characters, then their CRC-32 in
six base-62 digits), ``jwt`` (header that decodes to a JSON object with
``alg``; of any length) and ``pem`` (private key from its BEGIN to its END line; without an END
line, to the end of the base64 that follows).  Spans are start and end (exclusive)
in code points.

Defined cases: null text is empty and has no span; very long texts are scanned
whole; repeated rows are scanned alike; an empty table gives an empty result;
clashing extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, pick, texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem")
JWT = KINDS.index("jwt")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_BEGIN = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
#: Base64, header lines, white space, and what quoting or a string literal puts around lines.
_BODY = r"""(?:[A-Za-z0-9+/=]++|-(?!----)|:(?:(?!-----)[^\r\n\\])*+|[\s\\"'>|#*,;]++)*+"""
_GAP = r"""(?:[\s"'>|#*,;]|\\[nrt])++"""
#: Without an END line: known headers, long base64 words, and whole lines of base64.
_OPEN_BODY = (
    rf"(?:{_GAP}(?:[A-Z][A-Za-z0-9]*+-[A-Za-z0-9-]++|Comment|Version):[^\r\n\\]*+)*+"
    rf"(?:{_GAP}(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|[A-Za-z0-9+/]++={{1,2}})|"
    r"""["']?(?:\r?\n|(?:\\r)?\\n)[\x20\t>"']*+[A-Za-z0-9+/]++={0,2}(?=[\x20\t"']*+(?:[\r\n\\]|\Z)))*+"""
)

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "jwt": re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),  # what follows the header
    "pem": re.compile(rf"{_BEGIN}(?:{_BODY}-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|{_OPEN_BODY})"),
}
RUN = re.compile(r"[A-Za-z0-9_-]*")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "hex": tuple(f"{k:04x}" for k in range(1 << 16)),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}


def crc_digits(body: str) -> str:
    """The checksum such tokens embed: CRC-32 of the body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _header_is_json(head: str) -> bool:
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


VALID = {
    "assign": lambda m: len(m[2]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "hex": lambda m: len(m[0]) >= 24,
    "github": lambda m: crc_digits(m[0][4:34]) == m[0][34:],
    "npm": lambda m: crc_digits(m[0][4:34]) == m[0][34:],
    "jwt": _header_is_json,
    "pem": lambda m: True,
}


class Scanner:
    """Finds spans in one text; holds the automaton."""

    def __init__(self):
        self.auto = ahocorasick.Automaton()
        for rank, kind in enumerate(KINDS):
            for word in KEYWORDS[kind]:
                self.auto.add_word(word, (rank, len(word) - 1))
        self.auto.make_automaton()
        self.match = [PATTERNS[k].match for k in KINDS]
        self.valid = [VALID[k] for k in KINDS]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then by kind as listed."""
        # lower-casing of A-Z alone keeps every position
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        end, out = [0] * len(KINDS), []
        run, rest = 0, None  # the end of the token characters last read, and what follows them
        for at, (rank, back) in self.auto.iter(low):
            start = at - back
            if rank == JWT:
                if start < end[rank]:
                    continue
                if start >= run:
                    run = RUN.match(text, start).end()
                    rest = self.match[rank](text, run)
                if rest and run - start > 3 and text.startswith("eyJ", start):
                    end[rank] = rest.end()
                    if self.valid[rank](text[start:run]):
                        out.append((start, rank, rest.end()))
            elif start >= end[rank] and (m := self.match[rank](text, start)):
                end[rank] = m.end()
                if self.valid[rank](m):
                    out.append((start, rank, m.end()))
        out.sort()
        return [(KINDS[r], s, e) for s, r, e in out]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans) -> str:
    """The text with each span, overlaps merged, replaced by a marker of its first kind.
    The key name of an assignment goes with its value."""
    out, at = [], 0
    for kind, s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{kind} removed]"]
        at = e
    return "".join(out) + text[at:]


def scan(df: DataFrame, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """Columns ``keep`` (alias -> column), spans (array of kind, start, end) and redacted text."""
    keep = keep or {"doc_id": "doc_id"}
    kinds = {a: df.schema[c].dataType.simpleString() for a, c in keep.items()}

    def start():
        find = Scanner()

        def f(batch):
            rows = texts(batch, "_text")
            found = [find(t) for t in rows]
            return [batch.column(a) for a in kinds] + [
                [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found],
                [redact(t, x) if x else t for t, x in zip(rows, found)],
            ]

        return f

    schema = ", ".join([f"`{a}` {k}" for a, k in kinds.items()] + ["spans array<struct<kind:string,start:long,end:long>>", "redacted string"])
    return arrow_map(pick(df, **keep, _text=text_col), schema, start)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def start():
        find = Scanner()

        def f(batch):
            found = [find(t) for t in texts(batch)]
            base = [[x for x in one if x[0] in BASE_KINDS] for one in found]
            count = lambda kind: [sum(x[0] == kind for x in one) for one in base]
            return [batch.column("doc_id"), *map(count, BASE_KINDS), [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(x) for x in found]]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(pick(docs, doc_id="doc_id", text="text"), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", start)


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_secret_scan`` that SQL can tell: those of the base kinds."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _base_sql() -> str:
    """Leftmost searches of each whole text; a match ends after the lengths of all matches and gaps up to it."""

    def found(kind: str, pattern: str, group: int, least: int) -> str:
        pattern = pattern.replace("'", "''")
        return f"""
  SELECT r, {BASE_KINDS.index(kind)} AS rank, '{kind}' AS kind, upto - length(m) AS s, upto AS e FROM (
    SELECT r, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS upto FROM (
      SELECT r, unnest(range(len(ms))) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(gs) AS g FROM (
        SELECT r, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs FROM texts)))
  WHERE length(g) >= {least}"""

    # A-Z and a-z alone: the engine's own case folding takes other letters for them as well
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = " UNION ALL ".join([found("assign", assign, 2, 6), found("access", "AKIA[A-Z0-9]+", 0, 20), found("hex", "[0-9a-f]+", 0, 24)])
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans})
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')) AS base_sha256
FROM texts LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""


BASE_SQL = _base_sql()
