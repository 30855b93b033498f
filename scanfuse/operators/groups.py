"""Work on all rows of a key together, for keys whose rows have a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfuse.operators.components import staged

#: Keys with up to this many rows a side are worked on whole; larger ones are dealt to tiles.
WHOLE = 65_536
Columns = dict[str, np.ndarray]


def crowded(sides: list[DataFrame], key: str, most: int = WHOLE) -> DataFrame | None:
    """The keys that have over `most` rows on a side; None if there are none."""
    counts = [side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key) for side in sides]
    full = counts[0]
    for more in counts[1:]:
        full = full.unionByName(more)
    full = staged(full.distinct(), "crowded")
    return None if full.isEmpty() else full


def together(sides: list[DataFrame], key: str, work: Callable[[Any, list[Columns]], Iterator[dict[str, Any]]], schema: str, in_order: bool = False) -> DataFrame:
    """What `work` yields for each key, as columns of `schema`: it gets the key's value and, of each side, the key's rows as NumPy columns. Rows without a key drop.

    One shuffle brings all sides to their key, and a task holds the rows of one key at a time. in_order: keys go by ranges, so that like ones follow each other in one task.
    """
    kinds = {f.name: f.dataType for side in sides for f in side.schema.fields if f.name != key}
    rows = None
    for no, side in enumerate(sides):
        own = side.where(F.col(key).isNotNull()).select(key, F.lit(no).cast("byte").alias("_side"), *((F.col(c) if c in side.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
        rows = own if rows is None else rows.union(own)
    rows = (rows.repartitionByRange(key) if in_order else rows.repartition(key)).sortWithinPartitions(key, "_side")
    names = [[c for c in side.columns if c != key] for side in sides]

    def one(at: pa.Scalar, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ends = np.searchsorted(table.column("_side").to_numpy(), np.arange(len(names) + 1))
        parts = [{c: table.column(c).slice(a, b - a).to_numpy() for c in has} for has, a, b in zip(names, ends, ends[1:])]
        for out in work(at.as_py(), parts):
            yield pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            start, column = 0, batch.column(0)
            for end in pc.run_end_encode(column).run_ends.to_numpy() if batch.num_rows else ():
                if held and not column[start].equals(at):
                    yield from one(at, held)
                    held = []
                at = column[start]
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from one(at, held)

    return rows.mapInArrow(run, schema)


def nearest_in(q: list[np.ndarray], t_id: np.ndarray, t: list[np.ndarray], k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the points t inside the radius for each of the points q (lists of x, y, z), ranked by (d2, t_id): their places in t and d2, a row a query, and how many there are. Past those, d2 is infinite.

    Queries are taken tile by tile; a tile's queries meet the targets within the radius of it.
    """
    n = len(q[0])
    at, d2 = np.zeros((n, k), np.int64), np.full((n, k), np.inf)
    order = np.argsort(t_id, kind="stable")  # what is nearer the front has the smaller id, and wins a tie
    order = order[np.isfinite(t[0] + t[1] + t[2])[order]]
    t = [a[order] for a in t]
    some = np.flatnonzero(np.isfinite(q[0] + q[1] + q[2]))
    if not len(some) or not len(order):
        return at, d2, np.zeros(n, np.int64)
    width = 4 * radius
    while True:
        tile, steps = np.zeros(len(some), np.int64), []
        for a in q:
            step, no = np.unique(np.floor(a[some] / width), return_inverse=True)
            steps.append(step)
            tile = tile * len(step) + no
        tiles, start = np.unique(tile_sorted := np.sort(tile), return_index=True)
        if len(tiles) * 32 <= len(some) or len(tiles) == 1 or width > 1e9 * radius:
            break
        width *= 2  # few queries a tile
    some = some[np.argsort(tile, kind="stable")]
    place, number = np.arange(len(order)), np.zeros(len(order), np.int64)
    for a, step in zip(t, steps):
        v = a[place]
        reach = radius + 1e-9 * (radius + np.abs(v))
        low, high = np.searchsorted(step, np.floor((v - reach) / width), "left"), np.searchsorted(step, np.floor((v + reach) / width), "right")
        has = high - low
        of = np.repeat(np.arange(len(v)), has)
        no = np.arange(len(of)) - np.repeat(np.cumsum(has) - has, has) + low[of]
        place, number = place[of], number[of] * len(step) + no
    by_tile = np.argsort(number, kind="stable")
    place, number = place[by_tile], number[by_tile]
    t_from, t_to = np.searchsorted(number, tiles, "left"), np.searchsorted(number, tiles, "right")
    limit, more = radius * radius, k + 4
    qs = [a[some] for a in q]
    for a, b, c, d in zip(start, np.r_[start[1:], len(some)], t_from, t_to):
        if c == d:
            continue
        near = place[c:d]
        here = [v[near] for v in t]
        size = max(1, 1_000_000 // (d - c))
        for e in range(a, b, size):
            f = min(e + size, b)
            dist = np.subtract.outer(qs[0][e:f], here[0])
            dist *= dist
            for p, v in zip(qs[1:], here[1:]):
                off = np.subtract.outer(p[e:f], v)
                off *= off
                dist += off
            if k == 1:
                best = dist.argmin(axis=1)
                at[some[e:f], 0], d2[some[e:f], 0] = near[best], dist[np.arange(f - e), best]
                continue
            row = np.arange(f - e)[:, None]
            if d - c > more:
                pick = np.argpartition(dist, more - 1, axis=1)[:, :more]
                pick.sort(axis=1)
                part = dist[row, pick]
            else:
                pick, part = np.broadcast_to(np.arange(d - c), dist.shape), dist
            rank = part.argsort(axis=1, kind="stable")
            part, pick = part[row, rank], pick[row, rank]
            if d - c > more:
                tied = np.flatnonzero((part[:, k - 1] == part[:, -1]) & (part[:, -1] < limit))  # more of them may be as near
                for i in tied:
                    pick[i, :k] = np.lexsort((np.arange(d - c), dist[i]))[:k]
                    part[i, :k] = dist[i, pick[i, :k]]
            has = min(k, d - c)
            at[some[e:f], :has], d2[some[e:f], :has] = near[pick[:, :has]], part[:, :has]
    d2[~(d2 < limit)] = np.inf
    return order[at], d2, np.isfinite(d2).sum(axis=1)


class Nearest:
    """nearest_in for queries that move a little from call to call. Of each query some more targets than asked for are known; a call ranks these again, and only queries that may have moved nearer to others are searched anew."""

    def __init__(self, queries: int, t_id: np.ndarray, t: list[np.ndarray]):
        self.order = np.argsort(t_id, kind="stable")
        self.t_id, self.t = t_id[self.order], [a[self.order] for a in t]
        self.place, self.known, self.reach = np.zeros((queries, 3)), None, np.full(queries, -np.inf)

    def find(self, q: list[np.ndarray], k: int, radius: float, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As nearest_in, of the queries `rows` (all by default) at q."""
        rows = np.arange(len(q[0])) if rows is None else rows
        more = 3 * k + 1
        if not len(self.t_id):
            return np.zeros((len(rows), k), np.int64), np.full((len(rows), k), np.inf), np.zeros(len(rows), np.int64)
        at = np.stack(q, axis=1)
        with np.errstate(invalid="ignore"):
            moved = np.sqrt(((at - self.place[rows]) ** 2).sum(axis=1))
        if self.known is None:
            self.known, self.held = np.zeros((len(self.place), more), np.int64), np.zeros(len(self.place), np.int64)
            pick, d2, anew = np.zeros((len(rows), k), np.int64), np.full((len(rows), k), np.inf), np.arange(len(rows))
        else:
            pick, d2 = self._ranked(q, rows, k, radius)
            bound = np.minimum(np.sqrt(d2[:, k - 1]), radius)
            anew = np.flatnonzero(~(bound * (1 + 1e-9) < self.reach[rows] - moved))
        if len(anew):
            some, q = rows[anew], [a[anew] for a in q]
            near, far, have = nearest_in(q, self.t_id, self.t, more, radius)
            near[~np.isfinite(far)] = len(self.t_id)
            near.sort(axis=1)
            self.known[some], self.held[some], self.place[some] = near, have, at[anew]
            self.reach[some] = np.where(have == more, np.sqrt(far[:, -1]), radius)
            pick[anew], d2[anew] = self._ranked(q, some, k, radius)
        return self.order[pick], d2, np.isfinite(d2).sum(axis=1)

    def _ranked(self, q: list[np.ndarray], rows: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        known = self.known[rows]
        pick = np.minimum(known, len(self.t_id) - 1)
        off = [p[:, None] - a[pick] for p, a in zip(q, self.t)]
        d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
        d2[~(d2 < radius * radius) | (np.arange(known.shape[1]) >= self.held[rows, None])] = np.inf
        rank = d2.argsort(axis=1, kind="stable")[:, :k]
        row = np.arange(len(rows))[:, None]
        return pick[row, rank], d2[row, rank]
