"""Time-tolerance joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfuse.operators.components import fresh, staged


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, how: str = "inner", key: str = "s") -> DataFrame:
    """Each left row (key, l_id, ts) with the right row (key, r_id, ts) of its key that is nearest in time within ±tolerance; the smaller r_id on a tie.

    Times are integers. They are cut into buckets as wide as the tolerance: the left side goes to its own and both next buckets, so the
    rows meet in an equi-join on (key, bucket) whose groups a dense stream can only fill within that time.
    """
    l = left.select(key, "l_id", F.col("ts").alias("l_ts")).withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("l_ts") / tolerance) + k)))
    r = right.select(key, "r_id", F.col("ts").alias("r_ts")).withColumn("b", F.floor(F.col("r_ts") / tolerance))
    pairs = l.join(r, [key, "b"]).withColumn("dt", F.abs(F.col("l_ts") - F.col("r_ts"))).where(F.col("dt") <= tolerance)
    best = pairs.groupBy(key, "l_id").agg(F.min(F.struct("dt", "r_id")).alias("m")).select(key, "l_id", "m.r_id", "m.dt")
    if how == "inner":
        return best
    return left.select(key, "l_id").join(best, [key, "l_id"], "left")


def synced(left: DataFrame, sides: dict[str, tuple[DataFrame, bool]], tolerance: int, key: str = "s") -> DataFrame:
    """left with the nearest row of each named side (r_id as `<name>_id`); rows that lack a required side drop."""
    out = left.select(key, "l_id")
    for name, (right, required) in sides.items():
        near = nearest_in_time(left, right, tolerance, key=key).select(key, "l_id", F.col("r_id").alias(f"{name}_id"))
        out = out.join(near, [key, "l_id"], "inner" if required else "left")
    return out


def segments(frames: DataFrame, key: str = "s") -> DataFrame:
    """frames (key, ts, bad) with `segment`: a bad frame starts a new one."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("segment", F.sum(F.col("bad").cast("int")).over(w).cast("int"))


def scanned(rows: DataFrame, key: str, order: str, **values: tuple[Column, str]) -> DataFrame:
    """rows with running values within each key in the given order, by name (column, "sum" | "max" | "last"); "last" carries the latest value that is not null.

    A key of any length is many tasks' work: rows are dealt by (key, order) ranges and written; each range is scanned by itself and starts from the combined
    totals of the key's ranges before it, of which there are as many as ranges. Orders must be unique in a key.
    """
    part = fresh(rows, "part")
    named = {k: fresh(rows, "_" + k) for k in values}
    on = rows.repartitionByRange(key, order).withColumn(part, F.spark_partition_id())
    on = staged(on.withColumns({named[k]: c for k, (c, _) in values.items()}), "scan")
    how = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    inner = Window.partitionBy(part, key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = on.withColumns({k: how[kind](F.col(named[k])).over(inner) for k, (_, kind) in values.items()})
    total = {"sum": lambda k: F.sum(named[k]), "max": lambda k: F.max(named[k]), "last": lambda k: F.max_by(named[k], F.when(F.col(named[k]).isNotNull(), F.col(order)))}
    totals = on.drop(*values).groupBy(key, part).agg(*(total[kind](k).alias(named[k]) for k, (_, kind) in values.items()))
    over = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    k_, p_, b_ = (fresh(on, x) for x in ("key_before", "part_before", "value_before"))
    before = totals.select(F.col(key).alias(k_), F.col(part).alias(p_), F.struct(*(how[kind](F.col(named[k])).over(over).alias(k) for k, (_, kind) in values.items())).alias(b_))
    out = on.drop(*named.values()).join(before, F.col(key).eqNullSafe(F.col(k_)) & (F.col(part) == F.col(p_))).drop(k_, p_, part)
    was = lambda k: F.col(b_)[k]
    join = {"sum": lambda k: F.when(F.col(k).isNull(), was(k)).otherwise(F.col(k) + F.coalesce(was(k), F.lit(0))), "max": lambda k: F.greatest(F.col(k), was(k)), "last": lambda k: F.coalesce(F.col(k), was(k))}
    return out.withColumns({k: join[kind](k) for k, (_, kind) in values.items()}).drop(b_)


def long_segments(frames: DataFrame, key: str = "s") -> DataFrame:
    """As `segments`, for keys of any length; ts unique in a key."""
    return scanned(frames, key, "ts", segment=(F.col("bad").cast("int"), "sum")).withColumn("segment", F.col("segment").cast("int"))


def late_counts(rows: DataFrame, allowed: int, key: str = "s", chunk: int = 100_000) -> DataFrame:
    """Per key: rows (key, event_id in order of arrival, ts in ms), and how many come more than `allowed` after a later time has been seen.

    Arrivals are cut into chunks by event_id; a chunk starts from the latest time of those before it, so a long stream is many tasks' work.
    """
    cut = rows.withColumn("chunk", F.floor(F.col("event_id") / chunk))
    over = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(key, "chunk").agg(F.max("ts").alias("top")).select(key, "chunk", F.max("top").over(over).alias("before"))
    inner = Window.partitionBy(key, "chunk").orderBy("event_id")
    seen = cut.join(tops, [key, "chunk"]).withColumn("latest", F.greatest(F.max("ts").over(inner), "before"))
    return seen.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("latest") - allowed).alias("n_late"))
