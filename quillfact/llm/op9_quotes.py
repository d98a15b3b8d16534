"""Quotation linking in conversations, with DataFrame functions only.

Method.  Each line's quote level is the number of leading ``>``; its passage is
what follows, normalised (white space made one space, trimmed, lower-cased) and
hashed.  A message's own passages are its lines of level zero.  The source of a
passage is the first message of the conversation that has it as its own; one
aggregate gives the source of every (conversation, passage), so each quoted
passage joins one row at most and nothing is paired, however often a passage is
repeated or quoted.  A message replies to the source, earlier than itself, of
most of its shallowest linked passages (ties: the later message).  Deeper levels
are linked likewise and counted.

Conversations are put in reply order: threads by their first message, and a
thread's messages by turn.  A message without a link begins a thread.  The first
message of a thread and the depth in it come from pointer jumping over the
messages that reply, in as many rounds as the logarithm of the longest chain.
Positions are counted in three steps (blocks of 4,096 first turns, then of turns
within a thread, then rows), so a conversation that holds a third of all rows is
never sorted by one task.

The text without quotes keeps the lines of level zero, less lines that introduce
a quotation (``On ... wrote:`` before a quoted line), trimmed.

Defined cases: null text is an empty message and an empty message is kept; rows
with a null conversation or turn are kept, link with nothing, and have a null
thread and position; rows that repeat a (conversation, turn) are messages of
their own with the same links, ordered by role and text; blank passages link
nothing; a message never replies to itself or a later one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick

#: Turns of one step when positions are counted.
STEP = 4096
MARKS = r"^(?:[ \t]*>)+"
SPACES = r"[ \t\r\f\x0B]+"
INTRODUCES = r"^(?:on|am|le|el) .*(?:wrote|schrieb|écrit|escribió) ?:$"


def _prefix(counts: DataFrame, within: list[str], order: list[str], n: str) -> DataFrame:
    """``counts`` with n replaced by the sum of n of earlier rows of the same group."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(n, F.coalesce(F.sum(n).over(w), F.lit(0)))


def parsed(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages with ``lines``: level, whether it introduces a quotation, text and passage of each line."""
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def line(x):
        marks = F.regexp_extract(x, MARKS, 0)
        said = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, MARKS, ""), SPACES, " ")))
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), x.alias("line"), said.alias("said"))

    return rows.withColumn("lines", F.transform(split, line))


def _own(lines):
    """Lines of level zero that don't introduce a quotation."""
    quotes_next = lambda i: F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0
    return F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["said"].rlike(INTRODUCES) & quotes_next(i)))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked): the messages whose quotations have a source."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    lines = keyed.select("conv_id", "turn", F.explode("lines").alias("l")).where("l.said <> ''")
    # own and quoted lines from one reading of the messages, hashes alone
    lines = materialize(lines.select("conv_id", "turn", F.col("l.level").alias("level"), F.unhex(F.md5("l.said")).alias("passage")), "lines")
    sources = lines.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("source"))
    quoted = lines.where("level > 0").groupBy("conv_id", "turn", "level", "passage").agg(F.count("*").alias("n"))
    linked = quoted.join(sources, ["conv_id", "passage"]).where("source < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("up"), "n", "source")).alias("b"), F.sum("n").alias("n_linked"))
    return best.select("conv_id", "turn", F.col("b.source").alias("reply_to"), "n_linked")


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked, thread, depth) of ``replies``, by pointer jumping."""
    cur = materialize(links.select("*", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = cur.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = cur.join(up, ["conv_id", "thread"], "left")
        cur = materialize(
            joined.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads"
        )
        moved = cur.where("moved").limit(1).count()
        cur = cur.drop("moved")
        if not moved:
            return cur


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, n_quoted,
    max_level, n_linked, reply_to, thread, depth and position (from 0) in reply order."""
    messages = parsed(df, conv_col, turn_col, role_col, text_col)
    found = threads(replies(messages))
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    clean = F.regexp_replace(F.array_join(F.transform(_own(F.col("lines")), lambda x: x["line"]), "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    rows = messages.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("original"), clean.alias("text"),
        F.size(quoted).cast("long").alias("n_quoted"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("max_level"),
    )
    rows = rows.join(found, ["conv_id", "turn"], "left")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = rows.withColumns({
        "n_linked": F.coalesce("n_linked", F.lit(0)), "depth": F.coalesce("depth", F.lit(0)),
        "thread": F.when(known, F.coalesce("thread", "turn")),
    })
    rows = rows.withColumns({"a": F.floor(F.col("thread") / STEP), "b": F.floor(F.col("turn") / STEP)})
    sizes = materialize(rows.where(known).groupBy("conv_id", "a", "thread", "b").agg(F.count("*").alias("n")), "sizes")
    first = _prefix(sizes.groupBy("conv_id", "a").agg(F.sum("n").alias("before_a")), ["conv_id"], ["a"], "before_a")
    then = _prefix(sizes.withColumnRenamed("n", "before_b"), ["conv_id", "a"], ["thread", "b"], "before_b").join(first, ["conv_id", "a"])
    rows = rows.join(then.select("conv_id", "thread", "b", (F.col("before_a") + F.col("before_b")).alias("before")), ["conv_id", "thread", "b"], "left")
    here = Window.partitionBy("conv_id", "thread", "b").orderBy("turn", "role", "original")
    ordered = rows.where(known).withColumn("position", F.col("before") + F.row_number().over(here) - 1)
    columns = ["conv_id", "turn", "role", "text", "n_quoted", "max_level", "n_linked", "reply_to", "thread", "depth", "position"]
    return ordered.select(columns).unionByName(rows.where(~known).withColumn("position", F.lit(None).cast("long")).select(columns))


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE
rows AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS original FROM conversations),
split AS (SELECT r, conv_id, turn, string_split(original, chr(10)) AS ls FROM rows),
numbered AS (SELECT r, conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
lines AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+', 0), '[^>]', '', 'g')) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[ \t\r\f\x0B]+', ' ', 'g'), ' ')) AS said
  FROM numbered),
own AS (
  SELECT *, level = 0 AND NOT (regexp_matches(said, '^(?:on|am|le|el) .*(?:wrote|schrieb|écrit|escribió) ?:$')
    AND coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) > 0) AS kept
  FROM lines),
texts AS (
  SELECT r, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text,
    count(*) FILTER (WHERE level > 0) AS n_quoted, max(level) AS max_level
  FROM own GROUP BY r),
sources AS (SELECT conv_id, said, min(turn) AS source FROM lines WHERE level = 0 AND said <> '' GROUP BY ALL),
votes AS (
  SELECT l.conv_id, l.turn, l.level, s.source, count(*) AS n
  FROM lines l JOIN sources s USING (conv_id, said) WHERE l.level > 0 AND s.source < l.turn GROUP BY ALL),
links AS (
  SELECT conv_id, turn, source AS reply_to, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1),
climb AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1 FROM climb c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.thread),
tops AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM climb GROUP BY ALL)
SELECT r.conv_id, r.turn, r.role, t.text, t.n_quoted, CAST(t.max_level AS INT) AS max_level, CAST(coalesce(l.n_linked, 0) AS BIGINT) AS n_linked, l.reply_to,
  CASE WHEN r.conv_id IS NOT NULL THEN coalesce(p.thread, r.turn) END AS thread, CAST(coalesce(p.depth, 0) AS BIGINT) AS depth,
  CASE WHEN r.conv_id IS NOT NULL AND r.turn IS NOT NULL THEN
    row_number() OVER (PARTITION BY r.conv_id ORDER BY coalesce(p.thread, r.turn), r.turn, r.role NULLS FIRST, r.original) - 1 END AS position
FROM rows r JOIN texts t USING (r)
LEFT JOIN links l ON l.conv_id = r.conv_id AND l.turn = r.turn
LEFT JOIN tops p ON p.conv_id = r.conv_id AND p.turn = r.turn
"""
