"""Chat formatting by quotation linking.

Messages quote others with ``>`` at the start of a line, nested ``>>`` where a
quote holds a quote. Each maximal run of lines of one quote level is a passage;
its words, in lower case with blanks collapsed, are hashed and joined to the
hashes of what messages say themselves: whole messages, paragraphs and lines.
The earliest message of the conversation that says it is the original; else
the earliest of the corpus. A passage that matches nowhere as a whole goes to
the message that says most of its lines.

A message replies to the original of its lowest-level passage (the last of
these). One that replies to a message other than the one before it starts a
branch there; the others go on in the branch of the message before them. Every
message gets a path, which sorts a conversation in reply order: an answer
stands after what it answers, with what goes on from it. Quoted lines, and the
line that announces them, are cut from the texts.

DataFrame operations only. Texts are joined by hash to one row per hash and
conversation, so a line that everyone says or quotes meets one row. Running
values along a conversation are taken in stretches of turns first, then over
one row a stretch, so a conversation of any length is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

QUOTED = r"(?m)^(?:[ \t]*+>)++[^\n]*+(?:\n|\z)"
ANNOUNCED = r"(?m)^[^\n>]*?(?:wrote|writes|schrieb|écrit|escribió):[ \t\r]*+\n(?=[ \t]*+>)"
MARK = r"^((?:[ \t]*+>)++)"
STRETCH = 1024
NO_CONVERSATION = -(2**63)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s++", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them."""
    return F.regexp_replace(F.regexp_replace(text, ANNOUNCED, ""), QUOTED, "")


def message_id(*columns: str) -> Column:
    """128 bits of the digest of a row's columns; a null differs from every value, and from a null elsewhere."""
    return F.substring(F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)), 1, 16)


def _filled(units: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(units, normal)), lambda x: x != "")


def passages(quoting: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, level, place, lines) of messages (mid, conv_id, turn, text)."""
    lines = quoting.select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", MARK, 1)
    lines = lines.select("mid", "conv_id", "turn", "at", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), normal(F.substring("line", F.length(mark) + 1, F.length("line"))).alias("said"))
    along = Window.partitionBy("mid").orderBy("at")
    change = F.when(F.col("level") == F.lag("level").over(along), 0).otherwise(1)
    runs = lines.withColumn("change", change).withColumn("run", F.sum("change").over(along)).where("level > 0 and said <> ''")
    runs = runs.groupBy("mid", "conv_id", "turn", "run", "level").agg(F.min("at").alias("place"), F.sort_array(F.collect_list(F.struct("at", "said"))).alias("lines"))
    return runs.select("mid", "conv_id", "turn", "level", "place", F.col("lines.said").alias("lines"))


def link_quotes(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(mid, level, place, source_conv, source_turn, whole) of each passage; the source is null if no message says it.

    messages: (mid, conv_id, turn, text), one row a message.
    """
    found = scratch.write(passages(messages.where(F.col("text").rlike(MARK.replace("^", "(?m)^")))), "passages")
    wholes = found.select("mid", "conv_id", "turn", "level", "place", F.array_join("lines", " ").alias("said"), F.lit(True).alias("whole"))
    single = found.select("mid", "conv_id", "turn", "level", "place", F.explode(F.array_distinct("lines")).alias("said"), F.lit(False).alias("whole"))
    asked = scratch.write(wholes.union(single).withColumn("h", F.xxhash64("said")), "asked")
    hashes = asked.select("h").distinct()
    few = hashes.limit(500_001).count() <= 500_000
    own = own_text(F.col("text"))
    units = messages.select("conv_id", "turn", _filled(F.concat(F.array(own), F.split(own, r"\n[ \t\r]*+\n"), F.split(own, "\n"))).alias("units"))
    units = units.select("conv_id", "turn", F.explode("units").alias("said")).withColumn("h", F.xxhash64("said"))
    said = units.join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
    said = scratch.write(said.groupBy("conv_id", "h", "said").agg(F.min("turn").alias("first")), "said")
    # The earliest of the corpus, and the earliest of the other conversations: one of them is elsewhere for any message.
    anywhere = scratch.write(said.groupBy("h", "said").agg(F.min(F.struct("conv_id", "first")).alias("any")), "anywhere")
    others = said.join(anywhere, ["h", "said"]).where("conv_id <> any.conv_id").groupBy("h", "said").agg(F.min(F.struct("conv_id", "first")).alias("other"))
    anywhere = scratch.write(anywhere.join(others, ["h", "said"], "left"), "anywhere-else")
    here = asked.join(said, ["conv_id", "h", "said"], "left").select(asked["*"], F.when(F.col("first") < F.col("turn"), F.col("first")).alias("first"))
    both = here.join(anywhere, ["h", "said"], "left")
    elsewhere = F.when(F.col("any.conv_id") != F.col("conv_id"), F.col("any")).otherwise(F.col("other"))
    source = F.when(F.col("first").isNotNull(), F.struct("conv_id", "first")).otherwise(elsewhere)
    votes = both.select("mid", "level", "place", "whole", F.col("first").isNotNull().alias("inside"), source.alias("source")).where("source is not null")
    votes = votes.groupBy("mid", "level", "place", "whole", "inside", "source").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("mid", "level", "place").agg(F.max(F.struct("whole", "inside", "votes", F.col("source.first").alias("turn"), "source")).alias("best"))
    out = found.select("mid", "level", "place").join(best, ["mid", "level", "place"], "left")
    return scratch.write(out.select("mid", "level", "place", F.col("best.source.conv_id").alias("source_conv"), F.col("best.source.first").alias("source_turn"), F.col("best.whole").alias("whole")), "links")


def _latest_start(rows: DataFrame, starts: Column) -> DataFrame:
    """rows with ``branch``: the greatest of ``starts`` (null: none) at or before the turn in the conversation."""
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH)).withColumn("start", starts)
    tops = rows.groupBy("conv_id", "stretch").agg(F.max("start").alias("top"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("carried", F.max("top").over(before)).drop("top")
    within = Window.partitionBy("conv_id", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("inner", F.max("start").over(within))
    held = held.join(tops, ["conv_id", "stretch"])
    return held.withColumn("branch", F.coalesce("inner", "carried")).drop("stretch", "start", "inner", "carried")


def reply_paths(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, branch, path) of (conv_id, turn, reply_to): path array<long> sorts a conversation."""
    previous = F.col("turn") - 1
    starts = F.when(F.col("reply_to").isNotNull() & (F.col("reply_to") != previous), F.col("turn"))
    placed = scratch.write(_latest_start(heads, starts), "placed")
    branches = placed.where("branch = turn").select("conv_id", F.col("turn").alias("branch"), F.col("reply_to").alias("parent"))
    up = placed.select("conv_id", F.col("turn").alias("parent"), F.col("branch").alias("upper"))
    own = F.array(F.col("parent"), F.col("branch")).cast("array<long>")
    heads_ = scratch.write(branches.join(up, ["conv_id", "parent"], "left").select("conv_id", "branch", "upper", own.alias("head")), "heads-0")
    hop = 0
    while heads_.where("upper is not null").limit(1).count():  # each hop is twice as far as the one before
        hop += 1
        over = heads_.select("conv_id", F.col("branch").alias("upper"), F.col("upper").alias("next"), F.col("head").alias("over"))
        longer = F.when(F.col("over").isNull(), F.col("head")).otherwise(F.concat("over", "head"))
        heads_ = scratch.write(heads_.join(over, ["conv_id", "upper"], "left").select("conv_id", "branch", F.col("next").alias("upper"), longer.alias("head")), f"heads-{hop}")
        scratch.drop(f"heads-{hop - 1}")
    heads_ = heads_.drop("upper")
    empty = F.array().cast("array<long>")
    out = placed.join(heads_, ["conv_id", "branch"], "left")
    return out.select("conv_id", "turn", "branch", F.concat(F.coalesce("head", empty), F.array(F.col("turn").cast("long"))).alias("path"))


def link_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, scratch: Scratch | None = None
) -> DataFrame:
    """(conv_id, turn, role, reply_path, reply_to, n_quotes, n_linked, max_level, outside, text) of each row.

    reply_path: turns plus 2**63, padded to 20 digits and joined by dots, so that
    it sorts as text within a conversation. reply_to: turn of the message answered, null if none is
    quoted. outside: passages whose original is in another conversation. text:
    without quotes; null stays null. Rows without a conversation are one, that of
    the smallest long; a null turn counts as 0. Rows that repeat, nulls in the same places, count as
    one message and are each returned; of unlike rows of one turn, one reply counts for the order.
    """
    spark: SparkSession = messages.sparkSession
    scratch = scratch or Scratch(spark, "quote-links")
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.col(turn_col).cast("long").alias("given_turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    rows = rows.withColumn("group", F.coalesce("conv_id", F.lit(NO_CONVERSATION))).withColumn("mid", message_id("group", "turn", "role", "text"))
    one = rows.select("mid", F.col("group").alias("conv_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    links = link_quotes(one, scratch)
    inside = (F.col("source_conv") == F.col("conv_id")) & (F.col("source_turn") < F.col("turn"))
    placed = links.join(one.where(F.col("text").contains(">")).select("mid", "conv_id", "turn").distinct(), "mid")
    per = placed.groupBy("mid").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("source_turn").alias("n_linked"),
        F.max("level").cast("long").alias("max_level"),
        F.count(F.when(~inside, 1)).alias("outside"),
        F.min(F.when(inside, F.struct("level", -F.col("place"), F.col("source_turn").alias("to")))).alias("reply"),
    )
    per = scratch.write(per.select("mid", "n_quotes", "n_linked", "max_level", "outside", F.col("reply.to").alias("reply_to")), "per-message")
    few = per.limit(200_001).count() <= 200_000
    heads = rows.select("mid", F.col("group").alias("conv_id"), "turn").join(F.broadcast(per) if few else per, "mid", "left")
    heads = heads.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))
    paths = reply_paths(heads, scratch).withColumnRenamed("conv_id", "group")
    out = rows.join(F.broadcast(per) if few else per, "mid", "left").join(paths, ["group", "turn"])
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        F.col("given_turn").alias("turn"),
        "role",
        F.array_join(F.transform("path", lambda t: F.lpad((t.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")), ".").alias("reply_path"),
        "reply_to",
        *[F.coalesce(c, zero).alias(c) for c in ("n_quotes", "n_linked", "max_level", "outside")],
        own_text(F.col("text")).alias("text"),
    )


def op8_quotation_linking(spark, sf_dir):
    return link_conversations(table(spark, sf_dir, "conversations"))
