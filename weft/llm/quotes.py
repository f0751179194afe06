"""Quotation linking: which earlier message each quoted passage comes from, and conversations without quotes.

All of it is column expressions and joins on hashes. A line's level is the number of `>` that it begins
with; a passage is a run of quoted lines of one level. A passage is normalised (marks off, lower case, white
space to single spaces) and hashed, and so are its paragraphs and its lines. An earlier message of the conversation offers the
hashes of its own words: the whole, its paragraphs (which survive another line width) and its lines. The
passage belongs to the latest earlier message that offers it whole. Else each paragraph and line counts for the
latest earlier message that offers it; the passage belongs to the message that most paragraphs, then most lines count
for, the latest among equals, if these are a SHARE of the passage's lines: one line that everybody writes links nothing.

A message replies to the source of its first linked passage of the lowest level. A thread is what such
replies join; its messages stand together, in order of turn, which puts every reply behind what it
replies to. One conversation may hold a third of all rows, and one line stand in all of them: what a line's latest
earlier message is, is found by blocks of turns, and places are counted from rows dealt out by range, so no task
gets them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.base import durable

QUOTED = r"^(?:[\x20\t]*>)+"
#: Announces a quote and says nothing itself.
ANNOUNCED = r"(?i)^[\x20\t]*(?:on .{1,200} wrote|am .{1,200} schrieb.{0,80}|le .{1,200} a écrit|el .{1,200} escribió)[\x20\t]*:[\x20\t]*$"
PARAGRAPHS = r"\n[\x20\t]*\n"
#: Bits of a turn that a block of turns is split by.
STEP = 10
#: Least share of a passage's lines that a message must account for.
SHARE = 1 / 3
KEY = ("conv_id", "turn", "message")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{A0}]+", " "))


def lines_of(text: Column) -> Column:
    """An array of (level, body) for a text's lines; level 0 is the writer's own."""

    def one(line):
        marks = F.regexp_extract(line, QUOTED, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("body"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1), one)


def passages_of(lines: Column) -> Column:
    """Runs of lines of one level, as (level, from, to): line numbers from 0, the end exclusive."""
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    found = F.transform(starts, lambda s, k: F.struct(F.get(lines, s)["level"].alias("level"), s.alias("from"), F.coalesce(F.get(starts, k + 1), n).alias("to")))
    return F.filter(found, lambda p: p["level"] > 0)


def own_text(text: Column) -> Column:
    """A text without its quoted lines, and without the lines that announce them."""
    lines = lines_of(text)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ANNOUNCED) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    own = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?m)" + QUOTED), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(text)


def _hashes(texts: Column) -> Column:
    """Distinct hashes of the normalised texts that have any letters."""
    clean = F.filter(F.transform(texts, normalised), lambda x: F.length(x) > 0)
    return F.array_distinct(F.transform(clean, lambda x: F.xxhash64(x)))


def _keyed(messages: DataFrame) -> DataFrame:
    """Adds `message`, a hash that tells apart messages of one turn. Equal rows are one message."""
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text",
        F.xxhash64(F.col("role").cast("string"), "text").alias("message"),
    )


def _latest(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(conv_id, h, turn, to_turn, to_message) for each of asked (conv_id, h, turn) that an earlier turn of offered
    (conv_id, h, to_turn, to_message) offers: the latest of these.

    Turns are looked at by their bits, STEP at a time: the latest earlier turn is in the same block of 2^STEP turns, or
    in an earlier block of the same block of blocks, and so on. Each level needs the latest offer of each block (a
    map-side maximum), and windows of at most 2^STEP blocks, whatever a line's or a conversation's rows are."""
    levels = range(0, 64, STEP)

    def blocks(turn):
        return F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(turn, k).alias("block")) for k in levels]))

    block = ["conv_id", "h", "level", "block"]
    held = offered.select("conv_id", "h", F.struct("to_turn", "to_message").alias("offer"), blocks(F.col("to_turn"))).groupBy(*block).agg(F.max("offer").alias("offer"))
    wanted = asked.select("conv_id", "h", "turn", blocks(F.col("turn")))
    both = held.withColumn("asks", F.lit(False)).unionByName(wanted.select(*block).distinct().withColumn("asks", F.lit(True)), allowMissingColumns=True)
    # a turn has 64 bits, so shifting by the last level's and once more leaves its sign
    above = F.shiftright(F.col("block"), STEP)
    earlier = Window.partitionBy("conv_id", "h", "level", above).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    found = durable(both.withColumn("before", F.max("offer").over(earlier)).filter("asks and before is not null").select(*block, "before"))
    best = wanted.join(found, block).groupBy("conv_id", "h", "turn").agg(F.max("before").alias("best"))
    return best.select("conv_id", "h", "turn", "best.to_turn", "best.to_message")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, passage, level, to_turn, to_message, whole) for each linked passage.

    passage numbers a message's passages from 0; whole: the source has it word for word. A passage that no
    earlier message of the conversation offers has no row. Messages without conv_id or turn link nothing. Of messages
    of one turn that offer the same, the one with the largest hash counts."""
    rows = _keyed(messages).filter("conv_id is not null and turn is not null")
    quoting = rows.filter(F.col("text").rlike(r"(?m)" + QUOTED)).select(*KEY, lines_of(F.col("text")).alias("lines")).dropDuplicates([*KEY])
    body = lambda p: F.transform(F.slice("lines", p["from"] + 1, p["to"] - p["from"]), lambda x: x["body"])
    parts = quoting.select(*KEY, F.posexplode(F.transform(passages_of(F.col("lines")), lambda p: F.struct(p["level"].alias("level"), F.array_join(body(p), "\n").alias("body")))).alias("passage", "p"))
    lines = lambda part: _hashes(F.split(part, "\n", -1))
    unit = lambda kind, h, n: F.struct(F.lit(kind).alias("kind"), h.alias("h"), n.cast("long").alias("n"))
    paragraphs = F.filter(F.transform(F.split("body", PARAGRAPHS, -1), lambda x: F.struct(normalised(x).alias("x"), F.size(lines(x)).alias("n"))), lambda x: F.length(x["x"]) > 0)
    units = F.concat(
        F.transform(_hashes(F.array("body")), lambda h: unit("whole", h, F.lit(0))), F.array_distinct(F.transform(paragraphs, lambda x: unit("paragraph", F.xxhash64(x["x"]), x["n"]))),
        F.transform(lines(F.col("body")), lambda h: unit("line", h, F.lit(1))),
    )
    parts = parts.select(*KEY, "passage", F.col("p.level").alias("level"), F.col("p.body").alias("body")).select(*KEY, "passage", "level", F.size(lines(F.col("body"))).alias("n_lines"), F.inline(units))
    asked = durable(parts)
    own = own_text(F.col("text"))
    # only conversations in which somebody quotes are looked at
    offering = rows.join(durable(asked.select("conv_id").distinct()), "conv_id", "left_semi").select(*KEY, own.alias("own"))
    said = _hashes(F.concat(F.array("own"), F.split("own", PARAGRAPHS, -1), F.split("own", "\n", -1)))
    offered = offering.select("conv_id", F.col("turn").alias("to_turn"), F.col("message").alias("to_message"), F.explode(said).alias("h"))
    met = asked.join(durable(_latest(asked.select("conv_id", "h", "turn").distinct(), offered)), ["conv_id", "h", "turn"])
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    by_source = met.groupBy(*KEY, "passage", "level", "n_lines", "to_turn", "to_message").agg(
        (of("whole", 1) > 0).alias("whole"), of("paragraph", 1).alias("paragraphs"), of("paragraph", F.col("n")).alias("held"), of("line", 1).alias("lines")
    )
    enough = by_source.filter(F.col("whole") | (F.greatest("held", "lines") >= F.col("n_lines") * SHARE - 1e-9))
    part = lambda name: F.when(~F.col("whole"), F.col(name)).alias(name)
    best = F.max(F.struct("whole", part("paragraphs"), part("lines"), "to_turn", "to_message")).alias("best")
    return enough.groupBy(*KEY, "passage", "level").agg(best).select(*KEY, "passage", "level", "best.to_turn", "best.to_message", "best.whole")


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, message, thread, depth) for messages that reply: follows (parent) to its end.

    Pointers are doubled, so a chain of n replies takes log2(n) rounds."""
    at = replies.select(*KEY, "to_turn", "to_message", F.lit(1).cast("long").alias("depth"))
    while True:
        ahead = at.select("conv_id", F.col("turn").alias("to_turn"), F.col("message").alias("to_message"), F.col("to_turn").alias("turn2"), F.col("to_message").alias("message2"), F.col("depth").alias("depth2"))
        at = durable(
            at.join(ahead, ["conv_id", "to_turn", "to_message"], "left").select(
                *KEY, F.coalesce("turn2", "to_turn").alias("to_turn"), F.when(F.col("turn2").isNull(), F.col("to_message")).otherwise(F.col("message2")).alias("to_message"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("turn2").isNotNull().alias("moved"),
            )
        )
        if at.filter("moved").isEmpty():
            return at.select(*KEY, F.col("to_turn").alias("thread"), F.col("to_message").alias("head"), "depth")


def _places(rows: DataFrame) -> DataFrame:
    """(conv_id, thread, head, turn, message, place): ranks in (thread, head, turn, message) order by conversation.

    Rows are dealt out by range and sorted, and written with numbers that rise in this order; a conversation has a run
    of numbers in each part that it has rows in, and what its earlier parts hold is added. The largest window has a row
    for each of a conversation's parts."""
    order = ["conv_id", "thread", "head", "turn", "message"]
    rows = durable(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("number", 33))
    runs = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = durable(runs.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), (F.col("first") - F.coalesce(before, F.lit(0))).alias("_from")))
    same = (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    return rows.join(runs, same).select(*order, (F.col("number") - F.col("_from")).alias("place"))


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each row of messages (conv_id, turn, role, text):

    conv_id, turn, role, parent_turn (what it replies to, or null), thread (the turn of the thread's first
    message), depth (replies between it and that), place (from 0 in the reply-ordered conversation),
    n_quoted (quoted lines), levels (deepest quote), n_links, links (as passage:level:turn, by passage,
    comma-joined), content (the text without quotes).

    Rows equal in all four columns are one message and share every value, the place too. Messages of one
    turn that differ are ordered by a hash. A null text has no quotes and null content. A message without
    conv_id or turn is its own thread; nulls are placed first, as one conversation. An empty table gives no
    rows; other columns are not read. Long texts are read whole; turns may be any numbers, time stamps too."""
    rows = _keyed(messages)
    found = durable(links(messages))
    reply = F.min(F.struct("level", "passage", "to_turn", "to_message")).alias("r")
    replies = found.groupBy(*KEY).agg(reply).select(*KEY, "r.to_turn", "r.to_message")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage", "level", "to_turn"))), lambda x: F.concat_ws(":", x["passage"].cast("string"), x["level"].cast("string"), x["to_turn"].cast("string"))), ",")
    facts = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_links"), listed.alias("links"), reply).select(*KEY, "n_links", "links", F.col("r.to_turn").alias("parent_turn"))
    threads = _threads(replies)
    tied = durable(facts.join(threads, [*KEY]).select(*(F.col(k).alias(f"_{k}") for k in KEY), "n_links", "links", "parent_turn", "thread", "head", "depth"))

    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
        return left.join(right, same[0] & same[1] & same[2], "left").drop(*(f"_{k}" for k in KEY))

    whole = matched(rows.select(*KEY).distinct(), tied)
    whole = whole.withColumns({"head": F.when(F.col("thread").isNull(), F.col("message")).otherwise(F.col("head")), "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_links": F.coalesce("n_links", F.lit(0)), "links": F.coalesce("links", F.lit(""))})
    whole = durable(whole)
    places = _places(whole.select("conv_id", "thread", "head", "turn", "message"))
    placed = matched(whole, places.select(*(F.col(k).alias(f"_{k}") for k in KEY), "place")).select(*(F.col(k).alias(f"_{k}") for k in KEY), "parent_turn", "thread", "depth", "place", "n_links", "links")
    lines = lines_of(F.col("text"))
    text = rows.select(*KEY, "role", own_text(F.col("text")).alias("content"), F.size(F.filter(lines, lambda x: x["level"] > 0)).alias("n_quoted"), F.array_max(F.transform(lines, lambda x: x["level"])).alias("levels"))
    return matched(text, placed).select("conv_id", "turn", "role", "parent_turn", "thread", "depth", "place", "n_quoted", "levels", "n_links", "links", "content")
