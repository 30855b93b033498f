"""Integer vectors of an embedding table, and rows of a block that meet queries in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfuse.llm.common import staged

#: Components past this would let a score outgrow a long.
LARGEST = 1 << 27
#: Stands for a null vec_id inside: after every other in a tie, never a query.
NO_ID = (1 << 63) - 1


def quantised(table: DataFrame, scale: int, name: str, **more: Column) -> DataFrame:
    """row (a number of its own for every row), vec_id, v (floor(scale * x) of each component) and `more`, written.

    table: vec_id, embedding (float or double array); other columns are not read. Vectors that are null or hold null or non-finite
    components take no part. Vectors may differ in length; what one lacks counts as zero. A component of over 2^27 after scaling is an error.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists("embedding", lambda x: F.abs(x.cast("double") * scale) > LARGEST)
    v = F.when(far, F.raise_error(F.lit("a component is too large for an integer score"))).otherwise(F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")))
    return staged(table.where(F.col("embedding").isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).cast("long").alias("vec_id"), v.alias("v"), *(c.alias(k) for k, c in more.items())), name)


def is_query(every: int) -> Column:
    return (F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)


def shown_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def matrix(column: pa.Array, dtype: type = np.int64) -> np.ndarray:
    """A list column as rows of one width; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    out = np.zeros((len(n), width), dtype=dtype)
    out[np.arange(width) < n[:, None]] = flat
    return out


def stacked(parts: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Rows of all parts, as wide as the widest or `width`."""
    width = max([width, *(p.shape[1] for p in parts)])
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def met(rows: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """rows and queries (of the same columns, with block) of one block in one partition, all rows before the first query."""
    both = rows.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    return both.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "asks")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Stretches of one block and kind, in the order of `met`. A block's stretches follow each other."""
    for b in batches:
        block, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
        for at, stop in zip(cuts, cuts[1:]):
            if stop > at:
                yield int(block[at]), bool(asks[at]), b.slice(at, stop - at)
