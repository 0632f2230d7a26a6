"""Conversations without quotations: quoted passages are linked to the messages that they were taken from.

A line whose start is one or more '>' is quoted, at as many levels; a run of lines of one level is a passage. Passages
are normalised (lower case, one space between words) and hashed, whole and by their first line. Each message's own text
is hashed likewise: whole, by paragraph and by line. Joins on the hash give each passage the first message that has it,
in the same conversation before the quoting turn, else in any other. A message replies to the latest message of its own
conversation that its shallowest linked passages come from, else to the turn before it; so parents come earlier, and the
rows of a conversation by turn, and of a turn by `repeat`, are in reply order. `assembled` joins them to conversations.

Hashes are aggregated to their first message before they are joined, so a passage that very many messages share is one
row, and no conversation is collected anywhere. Only messages with quotes are split into lines on that side.

A null text counts as empty. Quotes that nothing matches are removed all the same and counted. Rows that repeat
(conv_id, turn) are each formatted, numbered by their text and role; they are one message for links. Null conv_id or turn: quotes are removed, nothing
is linked. A null role is written as "unknown". An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.llm import shared

QUOTE = r"^(?: {0,3}>)++"  # possessive, so that many levels need no stack
ATTRIBUTION = r"(?i)^on .* wrote:\s*$"
#: Turns, and rows of one turn, of an assembled piece at most.
PIECE = 1000


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def _own(text: Column) -> Column:
    """The lines without quotes and without "On ... wrote:" before them, joined again."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTE) & ~x.rlike(ATTRIBUTION))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _keys(texts: Column) -> Column:
    """Hashes of the texts that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, _normal), lambda x: x != ""), F.md5))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message, passage, level, keys (hash of the whole, of the first line) of each quoted passage."""
    lines = messages.where(F.col("text").rlike(r"(?m)" + QUOTE)).select("conv_id", "turn", "message", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    marks = F.regexp_extract("text", QUOTE, 0)
    lines = lines.withColumns({"level": F.length(F.regexp_replace(marks, "[^>]", "")), "words": _normal(F.regexp_replace("text", QUOTE, ""))})
    per_message = lines.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_list(F.struct("line", "level", "words"))).alias("lines"))  # the lines of one text
    changes = F.transform("lines", lambda x, i: F.when((i > 0) & (F.get(F.col("lines.level"), i - 1) == x["level"]), 0).otherwise(1))
    starts = F.filter(F.transform(changes, lambda c, i: F.when(c == 1, i)), lambda i: i.isNotNull())
    runs = per_message.withColumn("starts", starts).select("conv_id", "turn", "message", "lines", F.posexplode("starts").alias("passage", "first"), F.col("starts").alias("all"))
    last = F.coalesce(F.get("all", F.col("passage") + 1), F.size("lines"))
    runs = runs.select("conv_id", "turn", "message", "passage", F.get(F.col("lines.level"), F.col("first")).alias("level"), F.filter(F.slice(F.col("lines.words"), F.col("first") + 1, last - F.col("first")), lambda w: w != "").alias("words"))
    runs = runs.where("level > 0 and size(words) > 0")
    return runs.select("conv_id", "turn", "message", "passage", "level", F.md5(F.array_join("words", " ")).alias("whole"), F.md5(F.get("words", F.lit(0))).alias("opening"))


def unquoted_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, repeat (0, 1, ... of the rows with this turn), role, text (without quotes), formatted, reply_to_turn, n_passages, n_linked, source_conv_id,
    source_turn (of the first passage that comes from another conversation)."""
    columns = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    raw = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))
    raw = raw.withColumns({"text": F.coalesce("text", F.lit("")), "message": F.md5(F.coalesce("text", F.lit("")))})
    scratch = shared.Scratch(conversations.sparkSession, "chat")
    passages = scratch.save(quoted_passages(raw.where("conv_id is not null and turn is not null").dropDuplicates(["conv_id", "turn", "message"])), "passages")

    # where each hash is found first, for the hashes that are quoted
    wanted = passages.select(F.explode(F.array("whole", "opening")).alias("key")).distinct()
    own = raw.where("conv_id is not null and turn is not null").withColumn("own", _own(F.col("text")))
    pieces = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    keys = own.select("conv_id", "turn", F.explode(_keys(pieces)).alias("key")).join(wanted, "key", "left_semi")
    firsts = scratch.save(keys.groupBy("conv_id", "key").agg(F.min("turn").alias("at")), "firsts")
    # of each hash the first two conversations, since a quotation is foreign only if it comes from another one than its own
    least = firsts.groupBy("key").agg(F.min("conv_id").alias("one"), F.max("conv_id").alias("last")).where("one < last")
    second = firsts.join(least, "key").where("conv_id > one").groupBy("key").agg(F.min(F.struct("conv_id", "at")).alias("second"))
    anywhere = firsts.groupBy("key").agg(F.min(F.struct("conv_id", "at")).alias("other")).join(second, "key", "left")

    def found(column: str) -> tuple[DataFrame, DataFrame]:
        return firsts.select("conv_id", F.col("key").alias(column), F.col("at").alias(f"{column}_at")), anywhere.select(F.col("key").alias(column), F.col("other").alias(f"{column}_other"), F.col("second").alias(f"{column}_second"))

    linked = passages
    for column in ("whole", "opening"):
        here, there = found(column)
        linked = linked.join(here, ["conv_id", column], "left").join(there, column, "left")
    earlier = lambda c: F.when(F.col(f"{c}_at") < F.col("turn"), F.col(f"{c}_at"))
    foreign = lambda c: F.when(F.col(f"{c}_other.conv_id") != F.col("conv_id"), F.col(f"{c}_other")).otherwise(F.col(f"{c}_second"))
    linked = linked.withColumn("at", F.coalesce(earlier("whole"), earlier("opening")))
    linked = linked.withColumn("other", F.when(F.col("at").isNull(), F.coalesce(foreign("whole"), foreign("opening"))))
    shallow = F.min(F.when(F.col("at").isNotNull(), F.struct("level", (-F.col("at")).alias("back"))))
    summed = linked.groupBy("conv_id", "turn", "message").agg(
        (-shallow["back"]).alias("quoted_turn"), F.count("*").alias("n_passages"), F.count_if(F.col("at").isNotNull() | F.col("other").isNotNull()).alias("n_linked"), F.min(F.when(F.col("other").isNotNull(), F.struct("passage", "other")))["other"].alias("source")
    )
    before = raw.where("conv_id is not null and turn is not null").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct().withColumn("before", F.col("turn") - 1)
    out = raw.join(summed, ["conv_id", "turn", "message"], "left").join(before, ["conv_id", "turn"], "left").withColumn("clean", _own(F.col("text")))
    several = Window.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_first("clean"), F.asc_nulls_first("role"))
    out = out.withColumn("repeat", F.row_number().over(several).cast("long") - 1)
    return out.select(
        "conv_id", "turn", "repeat", "role", F.col("clean").alias("text"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("clean"), F.lit("\n")).alias("formatted"),
        F.coalesce("quoted_turn", "before").alias("reply_to_turn"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("source.conv_id").alias("source_conv_id"), F.col("source.at").alias("source_turn"),
    )


def assembled(messages: DataFrame) -> DataFrame:
    """unquoted_conversations to conversations in reply order: conv_id, piece, turns, replies (the turn that each replies
    to), text, n_passages, n_linked. A piece has PIECE turns and so many rows of each at most, so that no conversation,
    however long, is in one row; the pieces of a conversation are numbered in order. Rows without a conversation or turn
    are each a piece of their own."""
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.monotonically_increasing_id())
    keyed = messages.withColumns({"alone": alone, "block": F.floor(F.col("turn") / PIECE), "again": F.floor(F.col("repeat") / PIECE)})
    row = F.struct("turn", "repeat", "reply_to_turn", "formatted")
    grouped = keyed.groupBy("conv_id", "block", "again", "alone").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.sum("n_passages").alias("n_passages"), F.sum("n_linked").alias("n_linked")
    )
    scratch = shared.Scratch(messages.sparkSession, "assembled")
    grouped = scratch.save(grouped.withColumn("id", F.monotonically_increasing_id()), "pieces")
    place = F.row_number().over(Window.partitionBy("conv_id", "alone").orderBy("block", "again")) - 1  # on keys: a task has no text
    places = scratch.save(grouped.select("conv_id", "alone", "block", "again", "id").select("id", place.cast("long").alias("piece")), "places")
    return grouped.join(shared.bounded(places), "id").select(
        "conv_id", "piece", F.col("rows.turn").alias("turns"), F.transform("rows", lambda r: r["reply_to_turn"]).alias("replies"),
        F.array_join("rows.formatted", "").alias("text"), "n_passages", "n_linked",
    )
