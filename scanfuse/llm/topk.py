"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfuse.llm.common import table
from scanfuse.llm.vectors import is_query, matrix, met, quantised, runs, shown_id, stacked


def _digits(x: int) -> list[tuple[int, int]]:
    """x as signed powers of two (place, ±1), no two of them neighbours, so that few additions make a product."""
    out, place = [], 0
    while x:
        if x & 1:
            sign = 2 - (x & 3)
            out.append((place, sign))
            x -= sign
        x >>= 1
        place += 1
    return out


class BitSlices:
    """A block of integer vectors, column by column: slice b of a column is a bitmap of the rows that have bit b of (value - the column's least)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.n = len(values)
        words = -(-self.n // 64)
        self.least, top = values.min(axis=0), values.max(axis=0)
        self.width = [int(t - l).bit_length() for l, t in zip(self.least.tolist(), top.tolist())]
        self.first = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        plain = np.zeros((int(self.first[-1]), words * 8), dtype=np.uint8)
        for d, width in enumerate(self.width):
            up = values[:, d] - self.least[d]
            for b in range(width):
                bits = np.packbits((up >> b) & 1 == 1, bitorder="little")
                plain[self.first[d] + b, : len(bits)] = bits
        self.total = len(plain)
        self.maps = np.concatenate([plain, ~plain]).view(np.uint64)  # a slice and, `total` further on, its complement
        everyone = np.zeros(words * 8, dtype=np.uint8)
        bits = np.packbits(np.ones(self.n, dtype=bool), bitorder="little")
        everyone[: len(bits)] = bits
        self.everyone = everyone.view(np.uint64)

    def weighted(self, q: np.ndarray, share: int = 256) -> tuple[list[np.ndarray], int]:
        """Slices, least first, of the sum of q times the columns, less its constant part and what its lowest places hold; and the most these can add, in units of slice 0.

        A product is a sum of shifted slices (complements for negative digits), and all that stand at one place are added at once: full adders
        turn three bitmaps of a place into one and a carry. Places whose bitmaps together weigh less than 1/share of the greatest sum are left out.
        """
        at: dict[int, list[int]] = {}
        for d, x in enumerate(q.tolist()):
            for place, sign in _digits(x):
                for b in range(self.width[d]):
                    at.setdefault(place + b, []).append(int(self.first[d]) + b + (0 if sign > 0 else self.total))
        greatest = sum(len(maps) << place for place, maps in at.items())
        low, slack = 0, 0
        while at and low < max(at) and (slack + (len(at.get(low, ())) << low)) * share < greatest:
            slack += len(at.get(low, ())) << low
            low += 1
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        place = low
        while carried or any(p >= place for p in at):
            stack = [self.maps[at[place]]] if place in at else []
            m = np.concatenate([*stack, *carried]) if stack or carried else np.zeros((0, len(self.everyone)), dtype=np.uint64)
            carried = []
            while len(m) > 1:
                k = max(1, len(m) // 3)
                if len(m) == 2:
                    carried.append(m[:1] & m[1:])
                    m = m[:1] ^ m[1:]
                    continue
                a, b, c = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (half & c))
                m = np.concatenate([half ^ c, m[3 * k :]])
            out.append(m[0] if len(m) else np.zeros(len(self.everyone), dtype=np.uint64))
            place += 1
        return out, -(-slack // (1 << low)) if slack else 0

    def top(self, q: np.ndarray, k: int, ids: np.ndarray, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but those at the places `without`, ties to the smaller id."""
        rows = self.everyone.copy()
        for r in without.tolist():
            rows[r >> 6] &= ~np.uint64(1 << (r & 63))
        have = int(np.bitwise_count(rows).sum())
        if not have:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slices, slack = self.weighted(q)
        # downward from the most significant slice: the k-th largest sum
        equal, above, kth = rows, 0, 0
        for b in range(len(slices) - 1, -1, -1):
            hit = equal & slices[b]
            n = int(np.bitwise_count(hit).sum())
            if above + n >= min(k, have):
                equal, kth = hit, kth | 1 << b
            else:
                above += n
                equal = equal & ~slices[b]
        # who may reach it with what was left out: downward once more against the bound; these are scored exactly
        bound, equal, over = max(0, kth - slack), rows, np.zeros_like(rows)
        for b in range(len(slices) - 1, -1, -1):
            if bound >> b & 1:
                equal = equal & slices[b]
            else:
                over |= equal & slices[b]
                equal = equal & ~slices[b]
        found = np.flatnonzero(np.unpackbits((over | equal).view(np.uint8), bitorder="little"))
        scores = self.values[found] @ q
        best = np.lexsort((ids[found], -scores))[:k]
        return found[best], scores[best]


def _search(k: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, index = None, [], None
        for at, asks, b in runs(batches):
            if at != block:
                block, parts, index = at, [], None
            v, row, vec_id = matrix(b.column("v")), b.column("row").to_numpy(), b.column("vec_id").to_numpy()
            if not asks:
                parts.append((v, row, vec_id))
                continue
            if not parts:
                continue
            if index is None:
                rows, ids = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                by_row = np.argsort(rows)
                index = BitSlices(stacked([p[0] for p in parts]))
                parts = parts[:1]
            width = index.values.shape[1]
            v = np.pad(v, ((0, 0), (0, max(0, width - v.shape[1]))))[:, :width]
            own = np.searchsorted(rows, row, sorter=by_row)
            out = []
            for j in range(len(row)):
                mine = by_row[own[j] : own[j] + 1] if own[j] < len(rows) and rows[by_row[own[j]]] == row[j] else np.zeros(0, np.int64)
                found, scores = index.top(v[j], k, ids, mine)
                out.append((np.full(len(found), row[j]), np.full(len(found), vec_id[j]), ids[found], scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["row", "query_id", "vec_id", "score"])

    return visit


def top_k(rows: DataFrame, queries: Column, k: int = 10, block_rows: int = 1 << 16) -> DataFrame:
    """The k rows with the highest inner product to each row that `queries` marks, itself left out: query_id, rank (from 1), vec_id, score.

    rows: as `quantised` returns them. Ties go to the smaller vec_id; a null vec_id stands last. Rows that repeat a vec_id are rows of their own. Fewer than k rows: all. No rows: an empty result.

    Rows lie in blocks of at most about `block_rows`, by a hash of their number, so that equal vectors spread. A block is bit-sliced once, in one task, and queries go to every block, as the task
    holds a block and streams queries. A block gives k rows a query; the best of these are the answer.
    """
    spark = rows.sparkSession
    n = rows.count()
    blocks = max(-(-n // block_rows), min(-(-n // 2048), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    asked = rows.where(queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = met(rows.withColumn("block", block), asked, blocks).mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select(shown_id("query_id").alias("query_id"), "rank", shown_id("vec_id").alias("vec_id"), "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings"), 1024, "vectors"), is_query(100))


ORACLE = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
 FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM n WHERE rank <= 10"""
