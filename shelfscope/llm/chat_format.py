"""Chats from messages that quote each other, in DataFrame functions only.

Leading ``>`` marks give every line its quote level. Quoted passages (single lines, and all lines of a level together) and
the passages of the messages' own text are normalised and hashed; a quote belongs to the latest earlier message of the conversation
that holds its passage. The outermost quote that can be placed names the message replied to. Replies form
threads, and a conversation is read thread by thread, replies behind what they answer, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, let, stage
from shelfscope.operators.ordered import rank_rows

_MARKS = r"^[ \t]*((?:>[ \t]?)*)"
_ATTRIBUTION = r"^.*\bwrote:[ \t]*$"


def parsed_lines(text: Column) -> Column:
    """Lines as (level, body), in order; a line that only says who wrote the quote below it is left out."""
    raw = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))
    read = F.transform(raw, lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body"), line.rlike(_ATTRIBUTION).alias("says")))
    follows = lambda x, lines, i: x["says"] & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > x["level"])
    return let(read, lambda lines: F.filter(lines, lambda x, i: ~follows(x, lines, i)))


def normalised(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f ]+", " "))


def _joined(lines: Column, level) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: level(x["level"])), lambda x: x["body"]), "\n")


def _passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, whole, hash, passage): single lines and whole levels; level 0 is a message's own text."""
    single = messages.select("conv_id", "turn", F.explode("lines").alias("x")).select("conv_id", "turn", "x.level", F.lit(0).alias("whole"), F.col("x.body").alias("body"))
    levels = messages.select("conv_id", "turn", "lines", F.explode(F.array_distinct(F.transform("lines", lambda x: x["level"]))).alias("level"))
    whole = levels.select("conv_id", "turn", "level", F.lit(1).alias("whole"), _joined(F.col("lines"), lambda x: x == F.col("level")).alias("body"))
    every = single.unionByName(whole).withColumn("passage", normalised(F.col("body"))).filter("passage != ''")
    return every.select("conv_id", "turn", "level", "whole", F.xxhash64("passage").alias("hash"), "passage").distinct()


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages whose quotes can be placed."""
    quoting = messages.filter(F.exists("lines", lambda x: x["level"] > 0))
    quotes = stage(_passages(quoting).filter("level > 0"), "quotes")
    # Only passages that somebody quotes are looked for in the conversation.
    wanted = stage(quotes.select(F.col("conv_id").alias("c"), F.col("hash").alias("h")).distinct(), "wanted")
    own = _passages(messages.select("conv_id", "turn", F.filter("lines", lambda x: x["level"] == 0).alias("lines")))
    own = own.join(hinted(wanted, 40), (F.col("conv_id") == F.col("c")) & (F.col("hash") == F.col("h")), "left_semi")
    own = own.select("conv_id", "turn", "hash", "passage").distinct()
    none = F.lit(None)
    events = quotes.select("conv_id", "turn", "hash", "passage", "level", "whole", none.cast(messages.schema["turn"].dataType).alias("source"))
    events = events.unionByName(own.select("conv_id", "turn", "hash", "passage", none.cast("int").alias("level"), none.cast("int").alias("whole"), F.col("turn").alias("source")))
    # The passage itself is part of the key: equal hashes of unequal passages do not meet.
    earlier = Window.partitionBy("conv_id", "hash", "passage").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    placed = events.withColumn("found", F.max("source").over(earlier)).filter("level IS NOT NULL AND found IS NOT NULL")
    best = F.max(F.struct((-F.col("level")).alias("l"), "whole", "found"))
    return placed.groupBy("conv_id", "turn").agg(best["found"].alias("parent_turn"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of the linked messages: each round doubles how far up a message has looked."""
    known = stage(links.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        up = known.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread_turn").alias("next"), F.col("depth").alias("more"))
        joined = known.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread_turn") == F.col("t")), "left")
        known = stage(
            joined.select("conv_id", "turn", F.coalesce("next", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads"
        )
        if known.filter("moved").isEmpty():
            return known.drop("moved")
        known = known.drop("moved")


def format_chats(messages: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per message: ``conv_id``, ``turn``, ``role``, ``parent_turn``, ``thread_turn``, ``depth``, ``n_quoted``,
    ``position`` in the conversation, ``content`` without quotes, and ``formatted`` with its role.

    A null text counts as empty, a null role as ``unknown``. Messages with a null conversation or turn are neither linked nor linked
    to, and stand first. Equal rows are returned each and follow each other; of messages with equal turns none counts as
    earlier. A message whose quotes cannot be placed begins a thread. An empty table gives no rows; other columns are not
    read. ``hot_rows`` is the size from which a conversation is ordered in slices.
    """
    role = F.coalesce(F.trim("role"), F.lit("unknown"))
    read = messages.select("conv_id", "turn", role.alias("role"), parsed_lines(F.col("text")).alias("lines"))
    links = stage(linked(read.filter("conv_id IS NOT NULL AND turn IS NOT NULL")), "replies")
    threads = _threads(links)
    tree = links.join(threads, ["conv_id", "turn"]).withColumnsRenamed({"conv_id": "c", "turn": "t"})
    tree = stage(tree, "tree")
    content = F.trim(F.regexp_replace(_joined(F.col("lines"), lambda x: x == 0), r"\n{3,}", "\n\n"))
    content = F.regexp_replace(content, r"^\s+|\s+$", "")
    flat = read.select("conv_id", "turn", "role", content.alias("content"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    placed = flat.join(hinted(tree, 64), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    placed = placed.select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted", "content")
    order = [F.col(c).asc_nulls_first() for c in ("thread_turn", "turn", "role", "content", "n_quoted")]
    ranked = rank_rows(placed, ["conv_id"], order, "position", hot_rows)
    return ranked.withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")))
