"""Chat formatting by quotation linking.  DataFrame functions only.

A line's quote level is the number of ``>`` before it.  Paragraphs and lines of what a message quotes at each
level, normalised and hashed, are looked up among the paragraphs and lines that messages of the same conversation
wrote themselves, where each is kept once, under the message that wrote it first.  Of the shallowest level that
quotes a known message, the one with the most quoted characters is the one replied to.

The reply order is that of a walk over each thread, a message before its replies and those by turn.  The walk goes down
and up through every message, what comes next is known from the message's own replies and siblings, and pointer
doubling sums, over what is left of the walk, the messages and the steps down: two numbers for each message, however
long its chain is, in as many rounds as the longest thread's size has binary digits.  Texts are without quotes.

Defined results: a null text counts as empty; a message that quotes nothing known, or lacks conv_id or turn, replies
to none and starts its own thread; a quote of the message itself or of a later one links nothing; rows of one
(conv_id, turn) share one place; ties go to the latest message.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ordinal
from .storage import Scratch, read

_MARKS, _ATTRIBUTION = r"^(?:[ \t]*>)+[ \t]?", r"(?i)^\s*(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)[^>]*:\s*$"


def level(line: Column) -> Column:
    """How deep a line is quoted."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def normal(text: Column) -> Column:
    """What is hashed: words and digits in small letters, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(lines: Column) -> Column:
    """The normalised paragraphs and lines of some lines, without the empty ones and repeats."""
    paragraphs = F.split(F.array_join(lines, "\n"), r"\n\s*\n")
    return F.array_distinct(F.filter(F.transform(F.concat(paragraphs, lines), normal), lambda u: F.length(u) > 0))


def parse(messages: DataFrame) -> DataFrame:
    """Adds own (the text without quotes and attributions), depth_quoted, and units_own, units_quoted (level, unit)."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    rows = messages.withColumn("_l", F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line"))))
    quoted = F.exists("_l", lambda x: x["level"] > 0)
    own = F.filter("_l", lambda x: (x["level"] == 0) & ~(quoted & F.rlike(x["line"], F.lit(_ATTRIBUTION))))
    levels = F.array_distinct(F.filter(F.transform("_l", lambda x: x["level"]), lambda n: n > 0))
    at = lambda n: _units(F.transform(F.filter("_l", lambda x: x["level"] == n), lambda x: x["line"]))
    own_lines = F.transform(own, lambda x: x["line"])
    return rows.select(
        *messages.columns,
        F.when(quoted, F.regexp_replace(F.array_join(own_lines, "\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce("text", F.lit(""))).alias("own"),
        F.array_max(F.transform("_l", lambda x: x["level"])).alias("depth_quoted"),
        _units(own_lines).alias("units_own"),
        F.flatten(F.transform(levels, lambda n: F.transform(at(n), lambda u: F.struct(n.alias("level"), u.alias("unit"))))).alias("units_quoted"),
    )


def link(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), quoted_levels, reply_to (turn or null), thread (turn of its first message), depth (replies from there), behind (messages of the thread that follow).

    Conversations in reply order are the rows sorted by conv_id, thread and behind, the last one descending.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = scratch.table(parse(rows))
    known = rows.where("conv_id is not null and turn is not null")
    quotes = scratch.table(known.where("size(units_quoted) > 0").select("conv_id", "turn", F.explode("units_quoted").alias("q")).select("conv_id", "turn", "q.level", F.xxhash64("q.unit").alias("h1"), F.hash("q.unit").alias("h2"), F.length("q.unit").alias("chars")).distinct())
    columns = [F.col("own").alias("text"), F.col("depth_quoted").alias("quoted_levels")]
    if quotes.isEmpty():
        return rows.select("conv_id", "turn", "role", *columns, F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("thread"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("behind"))
    written = known.select("conv_id", "turn", F.explode("units_own").alias("unit")).select("conv_id", "turn", F.xxhash64("unit").alias("h1"), F.hash("unit").alias("h2"))
    written = written.groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("original"))
    met = quotes.join(scratch.table(written), ["conv_id", "h1", "h2"]).where("original < turn")
    reply = met.groupBy("conv_id", "turn", "level", "original").agg(F.sum("chars").alias("chars")).groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "original")).alias("m"))
    reply = scratch.table(reply.select("conv_id", "turn", F.col("m.original").alias("reply_to")))
    walked = scratch.table(walk(reply, scratch))
    found = rows.join(reply, ["conv_id", "turn"], "left").join(walked, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return found.select("conv_id", "turn", "role", *columns, "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"), F.coalesce("behind", zero).alias("behind"))


def walk(reply: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, thread, depth, behind of every message with a reply or that is one.  reply: conv_id, turn, reply_to, once a message."""
    edges = reply.select("conv_id", "turn", F.col("reply_to").alias("up"))
    # the next reply to the same message is the next row in the order of (conv_id, up, turn): no key holds many rows
    placed = scratch.table(ordinal.dense(edges, ("conv_id", "up", "turn"), "place"))
    after = placed.select("conv_id", "up", F.col("turn").alias("sibling"), (F.col("place") - 1).alias("place"))
    known = placed.join(after, ["place", "conv_id", "up"], "left").select("conv_id", "turn", "up", "sibling")
    child = edges.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = edges.select("conv_id", "turn").union(edges.select("conv_id", "up")).distinct()
    nodes = scratch.table(nodes.join(child, ["conv_id", "turn"], "left").join(known, ["conv_id", "turn"], "left"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # side 0: the walk comes down to a message; side 1: it leaves it, all its replies done
    down = nodes.select("conv_id", "turn", none.alias("side"), F.coalesce("child", "turn").alias("nt"), F.when(F.col("child").isNull(), one).otherwise(none).alias("ns"), one.alias("n"), one.alias("d"))
    up = nodes.select("conv_id", "turn", one.alias("side"), F.coalesce("sibling", "up").alias("nt"), F.when(F.col("sibling").isNotNull(), none).when(F.col("up").isNotNull(), one).alias("ns"), none.alias("n"), (-one).alias("d"))
    steps = scratch.table(down.union(up).withColumn("thread", F.when(F.col("nt").isNull(), F.col("turn"))))
    while True:
        ended, open_ = steps.where("nt is null"), steps.where("nt is not null")
        if open_.isEmpty():
            break
        ahead = steps.select("conv_id", F.col("turn").alias("nt"), F.col("side").alias("ns"), F.col("nt").alias("nt2"), F.col("ns").alias("ns2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("thread").alias("thread2"))
        moved = open_.join(ahead, ["conv_id", "nt", "ns"]).select("conv_id", "turn", "side", F.col("nt2").alias("nt"), F.col("ns2").alias("ns"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.col("thread2").alias("thread"))
        before, steps = steps, scratch.table(ended.union(moved))
        scratch.drop(before)
    return steps.where("side = 0").select("conv_id", "turn", "thread", (-F.col("d")).alias("depth"), (F.col("n") - 1).alias("behind"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it replies to and its place in the reply order."""
    return link(read(spark, sf_dir, "conversations"))
