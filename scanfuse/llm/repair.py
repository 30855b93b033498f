"""Conversation structure repair by a rank-convergence parallel Viterbi."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.llm.common import SPACES, discard, staged, table

#: States of what has been put out so far: nothing, ends in s, in u, in a.
START, S, U, A = range(4)
#: State after an inserted or re-roled row: an assistant's after a user's, else a user's.
_NEXT = (U, U, A, U)
#: State after a kept row of an initial; what is missing is not allowed.
_KEEP = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

Vector = tuple[int, int, int, int]


def _inserted(v: list[int]) -> Vector:
    """The least costs when rows may be inserted first; two in a row lead to every state they can."""
    for _ in range(2):
        v = [min(v[s], INSERT + v[_NEXT[s]]) for s in range(4)]
    return tuple(v)


#: Costs to go where no row is left: a complete conversation, or none, costs nothing.
END: Vector = _inserted([0, 1 << 40, 1 << 40, 0])


def _edits(symbol: str, s: int, after: Vector) -> Iterator[tuple[str, int, int]]:
    """Letter, cost to go and next state of what may be done with a row."""
    yield "D", DELETE + after[s], s
    if symbol != "x":
        low = symbol.lower()
        more = TRUNCATED if low != symbol else 0
        if (low, s) in _KEEP:
            yield "K", more + after[_KEEP[low, s]], _KEEP[low, s]
        yield "R", REROLE + more + after[_NEXT[s]], _NEXT[s]


@lru_cache(1 << 16)
def _before(symbol: str, after: Vector) -> Vector:
    return _inserted([min(c for _, c, _ in _edits(symbol, s, after)) for s in range(4)])


@lru_cache(1 << 14)
def backward(symbols: str, after: Vector) -> tuple[Vector, int]:
    """Costs to go before a chunk's rows, less their least, and that least; `after`: those behind it.

    symbols, one a row: the role's initial s, u, a or o for any other, as a capital where the text is truncated; x for a row that must go.
    """
    sunk = 0
    for c in reversed(symbols):
        after = _before(c, after)
        least = min(after)
        after, sunk = tuple(x - least for x in after), sunk + least
    return after, sunk


def trace(symbols: str, after: Vector, state: int, last: bool) -> tuple[list[str], int]:
    """The ASCII-least cheapest edits of a chunk entered in a state: letters for each row, inserts before it with it (behind the last row of all too), and the state at its end."""
    costs, sunk = [after], [0]
    for c in reversed(symbols):
        after = _before(c, after)
        sunk.append(min(after))
        after = tuple(x - sunk[-1] for x in after)
        costs.append(after)
    costs.reverse()
    sunk.reverse()
    out = []
    for k, c in enumerate(symbols):
        piece = ""
        while True:
            here = costs[k][state]
            ways = {letter: to for letter, cost, to in _edits(c, state, costs[k + 1]) if cost == here + sunk[k]}
            if "D" not in ways and INSERT + costs[k][_NEXT[state]] == here:
                piece, state = piece + "I", _NEXT[state]
                continue
            letter = min(ways)
            piece, state = piece + letter, ways[letter]
            break
        out.append(piece)
    while last and state not in (START, A):
        out[-1], state = out[-1] + "I", _NEXT[state]
    return out, state


@F.pandas_udf(T.StructType([T.StructField("costs", T.ArrayType(T.IntegerType())), T.StructField("sunk", T.LongType())]))
def _backward(symbols: pd.Series, after: pd.Series) -> pd.DataFrame:
    got = [backward(s, tuple(int(x) for x in a)) for s, a in zip(symbols, after)]
    return pd.DataFrame({"costs": [list(v) for v, _ in got], "sunk": [c for _, c in got]})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends(symbols: pd.Series, after: pd.Series, last: pd.Series) -> pd.Series:
    """The state at a chunk's end for each of the four at its start."""
    return pd.Series([[trace(s, tuple(int(x) for x in a), k, bool(e))[1] for k in range(4)] for s, a, e in zip(symbols, after, last)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(symbols: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([trace(s, tuple(int(x) for x in a), int(k), bool(e))[0] for s, a, k, e in zip(symbols, after, state, last)])


def damaged(messages: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as damage leaves them, by crc32 of `conv_id:turn` modulo 20: 0 drops, 1 empties the text, 2 takes out its `.!?`, 3 repeats the row, 4 makes it the user's. Nulls count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = messages.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "code")
    return rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("code", "copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Slim rows with `at`, a number that rises with (conv_id, turn, role, digest, row), and their chunk symbols. No text is sorted."""
    last = F.right(F.expr(f"trim(TRAILING '{SPACES}' FROM text)"), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "row", last.alias("last"))
    keys = ["conv_id", "turn", "role", "digest", "row"]
    slim = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    slim = staged(slim, "turns")
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    slim = slim.join(first, "at", "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    slim = slim.withColumns({"fault": fault, "kind": kind})
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind"))
    return slim.withColumn("symbol", symbol)


def _joined(items: str, field: str) -> Column:
    return F.array_join(F.transform(items, lambda x: x[field]), "")


def _chunks(slim: DataFrame, bits: int) -> DataFrame:
    """One row for each conversation and stretch of 2^bits numbers: its symbols, kinds and numbers in order, the chunk before it and whether one follows."""
    got = slim.groupBy("conv_id", F.shiftright("at", bits).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol", "kind"))).alias("items"))
    got = got.select("conv_id", "chunk", _joined("items", "symbol").alias("symbols"), _joined("items", "kind").alias("kinds"), F.transform("items", lambda x: x["at"]).alias("ats"))
    by = "OVER (PARTITION BY conv_id ORDER BY chunk)"
    return got.withColumns({"behind": F.expr(f"lag(chunk) {by}"), "ahead": F.expr(f"lead(chunk) {by}"), "kind_before": F.expr(f"lag(right(kinds, 1)) {by}")})


def _costs(chunks: DataFrame) -> DataFrame:
    """Chunks with `after`, the costs to go behind them, less a constant, and `sunk`, what their own rows add at least.

    Every chunk starts from a speculative vector, that of an ended conversation, which is right for the last. Then fix-up passes: a chunk whose follower's costs differ from those it took by
    more than a constant runs again. A chunk of ordinary turns brings any vector to the same one but for a constant, so that a pass or two is the rule; a stretch of rows that must all go
    hands its vector through and takes a pass more for every chunk. Conversations of one chunk are right at once and leave the loop.
    """
    done = chunks.withColumn("after", F.array(*(F.lit(x) for x in END))).withColumn("got", _backward("symbols", "after"))
    done = staged(done.select("*", "got.costs", "got.sunk").drop("got"), "costs")
    single = done.where("behind IS NULL AND ahead IS NULL")
    many = done.where("behind IS NOT NULL OR ahead IS NOT NULL")
    owned = None
    while True:
        follower = many.select(F.col("conv_id").alias("conv_"), F.col("chunk").alias("chunk_"), F.col("costs").alias("costs_"))
        on = many.join(follower, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("ahead") == F.col("chunk_")), "left").drop("conv_", "chunk_")
        on = on.withColumn("stale", F.col("costs_").isNotNull() & (F.col("costs_") != F.col("after")))
        stale = on.where("stale").withColumn("after", F.col("costs_")).withColumn("got", _backward("symbols", "after")).withColumns({"costs": F.col("got.costs"), "sunk": F.col("got.sunk")})
        now = staged(on.where("NOT stale").select(*many.columns, "stale").unionByName(stale.select(*many.columns, "stale")), "costs")
        if owned is not None:
            discard(owned)
        many, owned = now.drop("stale"), now
        if now.where("stale").isEmpty():
            return single.unionByName(many)


def _entered(chunks: DataFrame) -> DataFrame:
    """Chunks with the state in which the cheapest trace enters them: what each chunk does to the four states, composed backwards over twice as many chunks a round."""
    single = chunks.where("behind IS NULL AND ahead IS NULL").withColumn("state", F.lit(START))
    many = chunks.where("behind IS NOT NULL OR ahead IS NOT NULL")
    maps = staged(many.select("conv_id", "chunk", "behind", _ends("symbols", "after", F.col("ahead").isNull()).alias("ends")), "maps")
    before = maps.select(F.col("conv_id").alias("conv_"), F.col("chunk").alias("chunk_"), F.col("ends").alias("ends_"))
    on = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("up") == F.col("chunk_"))
    link = maps.select("conv_id", "chunk", F.col("behind").alias("up")).join(before, on, "left").select("conv_id", "chunk", "up", F.coalesce("ends_", F.array(*(F.lit(k) for k in range(4)))).alias("map"))
    link = staged(link, "maps")
    while not link.where("up IS NOT NULL").isEmpty():
        over = link.select(F.col("conv_id").alias("conv_"), F.col("chunk").alias("chunk_"), F.col("up").alias("up_"), F.col("map").alias("map_"))
        new = link.join(over, on, "left").select("conv_id", "chunk", F.col("up_").alias("up"), F.when(F.col("up").isNull(), F.col("map")).otherwise(F.transform("map_", lambda x: F.get("map", x))).alias("map"))
        new = staged(new, "maps")
        discard(link)
        link = new
    states = link.select(F.col("conv_id").alias("conv_"), F.col("chunk").alias("chunk_"), F.get("map", F.lit(START)).alias("state"))
    many = many.join(states, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("chunk") == F.col("chunk_"))).drop("conv_", "chunk_")
    return single.unionByName(many)


def _write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order, a piece of the audit before each text: conv_id, audit and the digest of the repaired conversation. Texts pass through the hash one by one."""
    open_, conv, audit, digest, state, empty, piece = False, None, [], None, START, True, ""

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    def put(line: str) -> None:
        nonlocal empty
        digest.update((line if empty else "\n" + line).encode("utf-8", "surrogatepass"))
        empty = False

    for b in batches:
        for conv_id, role, has_text, said, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "is_text", "piece", "text"))):
            if not open_ or conv_id != conv:
                if open_:
                    yield closed()
                open_, conv, audit, digest, state, empty = True, conv_id, [], hashlib.sha256(), START, True
            if not has_text:
                piece = said
                continue
            audit.append(piece)
            for letter in piece:
                if letter == "D":
                    continue
                if letter == "K":
                    state = {"s": S, "u": U, "a": A}[role[0]]
                    put(f"{role}:{text}")
                else:
                    state = _NEXT[state]
                    put(("user:" if state == U else "assistant:") + (text if letter == "R" else ""))
    if open_:
        yield closed()


def repair(messages: DataFrame, originals: DataFrame, chunk_bits: int = 12) -> DataFrame:
    """Repairs the role structure of conversations at the least cost; one row for every conv_id of `originals`.

    messages: conv_id, turn (integers), role, text (not null). Rows of a conversation are taken by turn (nulls first; ties by role, then text digest). A row's first fault counts: blank (no visible character),
    duplicate (its role and text came before), truncated (the last visible character is none of .!?). Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert of an empty
    user's or assistant's row 5; a truncated row that stays adds 5. The roles' initials of the result are (s?(ua)+)?; of the cheapest edits the ASCII-least letters in order are the audit.

    Returns conv_id, gaps (turns missing between the least and the greatest), blank, duplicate, truncated, illegal (adjacent rows whose initials are none of su, ua, au), cost, audit, repaired_sha256 (of `role:text` lines of the result).
    A null conv_id is a conversation of its own. Without rows: zeros, an empty audit, the digest of an empty string.

    A conversation of any length is cut into chunks of at most 2^chunk_bits rows, so none is gathered in a task. Its texts, however, meet one hash in their order, as one digest of all is asked for: they stream, one at a time, through the task of their conversation.
    Texts are shuffled once; sorting, faults and costs use digests and one letter a row.
    """
    slim = staged(_ordered(messages), "turns")
    chunks = _entered(_costs(_chunks(slim, chunk_bits)))
    chunks = staged(chunks.withColumn("pieces", _pieces("symbols", "after", "state", F.col("ahead").isNull())), "traced")
    # a conversation's cost: what stands before its first chunk, and what is sunk in all
    cost = F.sum("sunk") + F.sum(F.when(F.col("behind").isNull(), F.element_at("costs", START + 1)).otherwise(0))
    pair = lambda k: F.substring(F.col("kinds_"), k, F.lit(2))
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.length("kinds_") - 1), lambda k: ~pair(k).isin("su", "ua", "au")))
    each = chunks.withColumn("kinds_", F.concat(F.coalesce("kind_before", F.lit("")), "kinds")).withColumn("illegal", F.when(F.length("kinds_") > 1, wrong).otherwise(0))
    costs = each.groupBy("conv_id").agg(cost.cast("long").alias("cost"), F.sum("illegal").cast("long").alias("illegal"))
    counts = slim.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")))
    turns = slim.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))

    pieces = chunks.select(F.explode(F.arrays_zip(F.col("ats").alias("at"), F.col("pieces").alias("piece"))).alias("x")).select("x.*")
    keys = ["conv_id", "turn", "role", "digest", "row"]
    said = slim.join(pieces, "at").select(*keys, F.lit(False).alias("is_text"), "piece", F.lit(None).cast("string").alias("text"))
    texts = messages.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "row", F.lit(True).alias("is_text"), F.lit(None).cast("string").alias("piece"), "text")
    lines = said.unionByName(texts).repartition("conv_id").sortWithinPartitions(*keys, "is_text").withColumn("conv_id", F.col("conv_id").cast("long"))
    written = lines.select("conv_id", "role", "is_text", "piece", "text").mapInArrow(_write_out, "conv_id long, audit string, repaired_sha256 string")

    out = originals.select("conv_id").distinct()
    for part in (costs, counts, turns, written):
        part = part.withColumnRenamed("conv_id", "conv_")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repair_conversations(messages: DataFrame, chunk_bits: int = 12) -> DataFrame:
    """`repair` of rows (conv_id, turn, role, text; other columns are not read) as they are; null role and text count as one space."""
    one = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    return repair(_numbered(messages.select("conv_id", "turn", one("role"), one("text"))), messages, chunk_bits)


def _numbered(rows: DataFrame) -> DataFrame:
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows", dictionary=False)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return repair(_numbered(damaged(messages)), messages)
