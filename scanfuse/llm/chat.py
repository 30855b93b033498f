"""Chat formatting by quotation linking. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import discard, staged, table

#: A quoted line: up to any depth of '>' marks, each with blanks around it.
_QUOTE = r"^[ \t]*>"
_MARKS = r"^([ \t]*>)+[ \t]?"
#: What stands between two paragraphs.
_BLANK = r"\n[ \t]*\n"
#: Reply headers that mail programs put before a quotation.
_HEADER = r"^[ \t]*(On .+ wrote:|Am .+ schrieb.*:|Le .+ a écrit ?:|El .+ escribió:|-+ ?Original Message ?-+)[ \t]*$"


def normalised(text: Column) -> Column:
    """What two copies of a passage share: lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def _lines(text: Column) -> Column:
    """Lines as structs of quote level and text without marks."""
    depth = lambda s: F.length(F.regexp_replace(F.regexp_extract(s, _MARKS, 0), "[^>]", ""))
    return F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.struct(depth(s).alias("level"), F.regexp_replace(s, _MARKS, "").alias("line")))


def with_passages(rows: DataFrame) -> DataFrame:
    """Adds lines and passages to rows (quoting, text): runs of lines of one quote level over 0, as structs of level, normalised text and keys, in order; empty ones dropped.

    The keys are the run's text (rank 0), its paragraphs (1; a blank quoted line ends one) and its lines (2), so that a run that quotes a part of a message also finds it.
    Each step is a column of its own: inside a lambda an expression would be worked out anew for every element.
    """
    level = lambda k: F.element_at("lines", k)["level"]
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: (k == 1) | (level(k) != level(F.greatest(k - 1, F.lit(1)))))
    stop = lambda i: F.when(i + 2 <= F.size("starts"), F.get("starts", i + 1)).otherwise(F.size("lines") + 1)
    text = lambda k, i: F.array_join(F.transform(F.slice("lines", k, stop(i) - k), lambda x: x["line"]), "\n")
    runs = F.filter(F.transform("starts", lambda k, i: F.struct(level(k).alias("level"), F.when(level(k) > 0, text(k, i)).alias("line"))), lambda r: r["level"] > 0)
    ranked = lambda texts, rank: F.transform(F.array_distinct(F.filter(F.transform(texts, normalised), lambda s: s != "")), lambda s, k: F.struct(F.lit(rank).alias("rank"), k.alias("k"), s.alias("s")))
    keys = lambda t: F.concat(ranked(F.array(t), 0), ranked(F.split(t, _BLANK), 1), ranked(F.split(t, r"\n"), 2))
    found = F.filter(F.transform("runs", lambda r: F.struct(r["level"].alias("level"), normalised(r["line"]).alias("line"), keys(r["line"]).alias("keys"))), lambda r: r["line"] != "")
    out = rows.withColumn("lines", F.when(F.col("quoting"), _lines(F.col("text")))).withColumn("starts", F.when(F.col("quoting"), starts)).withColumn("runs", runs)
    return out.withColumn("passages", found).drop("starts", "runs")


def _body(lines: Column) -> Column:
    """Lines that quote nothing. A reply header goes too, where a quoted line follows it, at most one blank line between; a line that only looks like one stays."""
    quoted = lambda k: F.coalesce(F.get(lines, k)["level"] > 0, F.lit(False))
    before = lambda k: quoted(k + 1) | (F.coalesce(F.trim(F.get(lines, k + 1)["line"]) == "", F.lit(False)) & quoted(k + 2))
    kept = F.filter(lines, lambda x, k: (x["level"] == 0) & ~(F.rlike(x["line"], F.lit(_HEADER)) & before(k)))
    return F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """Links messages to the originals that they quote and orders them into conversations without quotes.

    messages: conv_id, turn (integers), role, text; other columns are not read. A message's own passages are its paragraphs, its lines and its whole
    body; a quoted passage is a run of lines of one nesting level, or where no message has all of it, its paragraphs, and where none has one, its
    lines: then it belongs to the message that has most of those. A passage belongs to the first message, by (conv_id, turn), that has the passage as its own,
    one of the same conversation before any other, and never to the message itself or a later one of its conversation. A message's parent
    is the original of its least nested linked passage, the first of those. Without one it answers the message before it in its
    conversation; the first has no parent. Quoted lines leave the body whether or not an original is found. A conversation whose first linked message quotes an earlier conversation is a branch of it.

    Returns one row per input row: conv_id, turn, role, parent_conv, parent_turn, linked (by quotation), quotes (passages quoted), links (of
    them linked), thread (conv_id of the root conversation), position (gapless from 0 in the thread, by conv_id and turn), body. Null text counts as empty; null roles stay
    null; null ids are values like any other that sort first and link to nothing. Rows that repeat (conv_id, turn) are one message in several parts: each has the parent that its own part quotes, quotes and links count all parts. An empty table gives an empty result.

    Only messages with a quoting line take part in the join; originals meet it as one row per passage hash, so a passage that a third of
    all messages share stays one key with one partner. Positions and turns before are found in ranges of the ordered rows, so a conversation of any
    length is many tasks' work.
    """
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", "role", text.alias("text"), F.rlike(text, F.lit(r"(?m)" + _QUOTE)).alias("quoting"))
    body = F.when(F.col("quoting"), _body(F.col("lines"))).otherwise(F.trim(F.regexp_replace("text", r"\r\n?", "\n")))
    rows = with_passages(rows).select("conv_id", "turn", "role", "quoting", body.alias("body"), "passages", F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "messages")

    asked = rows.where("quoting AND conv_id IS NOT NULL AND turn IS NOT NULL").select("row", "conv_id", "turn", F.posexplode("passages").alias("pos", "p")).select("row", "conv_id", "turn", "pos", F.col("p.level").alias("level"), F.sha2("p.line", 256).alias("run"), F.explode("p.keys").alias("key"))
    asked = asked.select("row", "conv_id", "turn", "pos", "level", "run", "key.rank", "key.k", F.sha2("key.s", 256).alias("hash"))
    asked = staged(asked, "quotations")
    wanted = asked.select("hash").distinct()
    own = F.array_distinct(F.filter(F.transform(F.concat(F.split("body", _BLANK), F.split("body", r"\n"), F.array("body")), normalised), lambda s: s != ""))
    has = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(own).alias("s")).select("conv_id", "turn", F.sha2("s", 256).alias("hash"))
    has = has.join(wanted, "hash", "left_semi")
    in_conv = has.groupBy("hash", "conv_id").agg(F.min("turn").alias("own_turn"))
    first = in_conv.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("own_turn").alias("turn"))).alias("any"))
    found = asked.join(in_conv, ["hash", "conv_id"], "left").join(first, "hash", "left")
    here = F.col("own_turn") < F.col("turn")
    there = (F.col("any.conv_id") < F.col("conv_id")) & F.col("own_turn").isNull()
    found = found.withColumn("at", F.when(here, F.struct(F.col("conv_id").alias("conv_id"), F.col("own_turn").alias("turn"))).when(there, F.col("any")))
    run = ["row", "conv_id", "turn", "pos", "level", "run"]
    found = found.groupBy(*run, "rank", "at").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    at = F.min(F.when(F.col("at").isNotNull(), F.struct("rank", (-F.col("n")).alias("n"), "k", "at")))["at"]
    found = found.groupBy(*run).agg(F.sum(F.when(F.col("rank") == 0, F.col("n"))).alias("n"), at.alias("at"))
    linked = found.groupBy("row", "conv_id", "turn").agg(F.sum("n").alias("quotes"), F.coalesce(F.sum(F.when(F.col("at").isNotNull(), F.col("n"))), F.lit(0)).alias("links"), F.min(F.when(F.col("at").isNotNull(), F.struct("level", "pos", "at"))).alias("best"))
    linked = staged(linked.select("row", "conv_id", "turn", "quotes", "links", F.col("best.at").alias("at")), "links")

    # a conversation branches off the earlier one that its first message with a foreign link quotes; roots by pointer doubling
    up = linked.where("at.conv_id < conv_id").groupBy("conv_id").agg(F.min(F.struct("turn", "at")).alias("x")).select("conv_id", F.col("x.at.conv_id").alias("root"))
    up = staged(up, "branches")
    while True:
        higher = up.select(F.col("conv_id").alias("root"), F.col("root").alias("over"))
        new = staged(up.join(higher, "root", "left").select("conv_id", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "branches")
        discard(up)
        up = new.select("conv_id", "root")
        if new.where("moved").isEmpty():
            break
    counts = linked.groupBy("conv_id", "turn").agg(F.sum("quotes").alias("quotes"), F.sum("links").alias("links"))
    out = rows.drop("passages", "quoting").join(linked.select("row", "at"), "row", "left").join(counts, ["conv_id", "turn"], "left").join(up, "conv_id", "left").withColumn("thread", F.coalesce("root", "conv_id"))

    # positions: range-sorted rows are numbered inside their partition and shifted by what the thread has in earlier ones
    order = ["thread", "conv_id", "turn", "role", "body", "at"]
    out = out.repartitionByRange(*(F.col(c) for c in order[:3])).sortWithinPartitions(*order).withColumn("at_row", F.monotonically_increasing_id())
    out = staged(out.withColumn("part", F.shiftright("at_row", 33).cast("int")), "ordered")
    runs = out.groupBy("part", "thread").agg(F.min("at_row").alias("first"), F.count("*").alias("n"))
    runs = runs.select("part", "thread", (F.col("first") - F.coalesce(F.expr("sum(n) OVER (PARTITION BY thread ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))).alias("shift"))
    # the turn before, likewise: inside the part, or the highest of the conversation's part before
    turns = out.where("conv_id IS NOT NULL").select("part", "conv_id", "turn").distinct()
    turns = turns.withColumn("first", F.expr("row_number() OVER (PARTITION BY part, conv_id ORDER BY turn) = 1")).withColumn("last", F.expr("lag(turn) OVER (PARTITION BY part, conv_id ORDER BY turn)"))
    tops = turns.groupBy("part", "conv_id").agg(F.max("turn").alias("top")).withColumn("before", F.expr("lag(top) OVER (PARTITION BY conv_id ORDER BY part)"))
    turns = turns.join(tops, ["part", "conv_id"]).select("conv_id", "turn", F.when(F.col("first"), F.col("before")).otherwise(F.col("last")).alias("last"))
    out = out.join(runs, out["part"].eqNullSafe(runs["part"]) & out["thread"].eqNullSafe(runs["thread"])).drop(runs["part"]).drop(runs["thread"]).join(turns, ["conv_id", "turn"], "left")
    is_linked = F.col("at").isNotNull()
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.when(is_linked, F.col("at.conv_id")).when(F.col("last").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(is_linked, F.col("at.turn")).otherwise(F.col("last")).alias("parent_turn"),
        is_linked.alias("linked"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"),
        F.coalesce("links", F.lit(0)).alias("links"),
        "thread",
        (F.col("at_row") - F.col("shift")).alias("position"),
        "body",
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
