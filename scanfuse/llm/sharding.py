"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.llm.common import staged, table

#: region, rack, shard number, weight
Leaf = tuple[str, str, int, float]


def layout(shards: int, per_rack: int = 5, per_region: int = 20) -> list[Leaf]:
    """`shards` of weight 1; racks and regions fill in order, so that one shard more is one leaf more and no other leaf changes its place."""
    return [(f"region{s // per_region}", f"rack{s // per_rack}", s, 1.0) for s in range(shards)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64): every bit of x decides about half the bits of the result."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def descend(keys: np.ndarray, weights: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Shards of hashed keys (uint64) in a tree of weights[region, rack, place] from 0 (no such shard) to 1.

    A try draws a region from the key and the try's number, a rack from that draw, a place from that, and is taken with the place's weight; else the next try starts at the root. So a shard gets keys by its weight. A
    changed weight only decides anew about the tries that meet that place: raised, it takes keys from others and gives none, lowered, it gives and takes none; all other places keep their keys.
    """
    out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
    tries = np.uint64(0)
    while len(left):
        h, at = _mixed(keys[left] ^ _mixed(np.full(len(left), tries))), []
        for width in weights.shape:
            at.append(((h >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64))
            h = _mixed(h ^ at[-1].astype(np.uint64))
        took = (h >> np.uint64(11)).astype(np.float64) / 2.0**53 < weights[tuple(at)]
        out[left[took]] = shards[tuple(at)][took]
        left, tries = left[~took], tries + np.uint64(1)
    return out


def place(key: Column, leaves: Sequence[Leaf], capacity: tuple[int, int, int] = (8, 4, 5), top: float = 1.0) -> Column:
    """Shard of a key by weighted hash draws down a tree of regions, racks and places (see `descend`).

    The tree has a fixed capacity: regions, racks a region, places a rack. Regions, racks and shards take its places as they come; places that none has taken are empty. A shard more is a place more with a weight, and nothing else changes.
    `top` is the greatest weight that a shard of this tree will ever have. The work of a key is the depth times capacity / (sum of weights / top), whatever the number of shards.
    Too small a capacity or top is an error.
    """
    weights, shards = np.zeros(capacity), np.zeros(capacity, dtype=np.int64)
    tree: dict[str, dict[str, int]] = {}
    for region, rack, shard, weight in leaves:
        racks = tree.setdefault(region, {})
        racks[rack] = racks.get(rack, -1) + 1
        at = list(tree).index(region), list(racks).index(rack), racks[rack]
        if any(k >= n for k, n in zip(at, capacity)) or not 0 <= weight <= top:
            raise ValueError(f"shard {shard} does not fit in a tree of {capacity} with weights up to {top}")
        weights[at], shards[at] = weight / top, shard
    if not weights.any():
        raise ValueError("no shard has a weight")

    @F.pandas_udf(T.IntegerType())
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(descend(keys.to_numpy(np.int64).view(np.uint64), weights, shards).astype(np.int32))

    return placed(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Puts every row into one of `shards` shards under the law `key`: doc_id and the shard count alone decide.

    docs: doc_id, text; other columns are not read. Null text counts as empty; a null doc_id is a key of its own.
    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot (gapless from 0 in each shard, by doc_id, then size and crc),
    grown_shard (the shard under one shard more). An empty table gives an empty result.

    Slots need no single task per shard: rows are range-sorted by (shard, doc_id), numbered inside their partition, and shifted by the
    rows of the same shard in earlier partitions. Shifts differ from one row per shard only where a shard spans partitions, so there
    are fewer than shards + partitions of them, which bounds the broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("*", place(F.col("doc_id"), layout(shards)).alias("shard"), place(F.col("doc_id"), layout(shards + 1)).alias("grown_shard"))
    order = ["shard", "doc_id", "size", "text_crc32"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = staged(rows.select("*", F.shiftright("at", 33).cast("int").alias("part")), "shards")
    runs = rows.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    shift = runs.select("part", "shard", (F.col("first") - before).alias("shift"))
    return rows.join(F.broadcast(shift), ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") - F.col("shift")).alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
