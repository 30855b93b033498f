"""Exact neighbour joins over a grid. Both sides meet in an equi-join on tiles a few radii wide, never a cross join: a query lies in one tile, a target goes to the tiles within the radius, two or three on average."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.operators.components import staged
from scanfuse.operators.grid import CELL, cells, voxel_samples
from scanfuse.operators.groups import WHOLE, Columns, crowded, nearest_in, together

TILE = ["ux", "uy", "uz"]
#: Tiles are this many radii wide.
WIDE = 4
_SUMS = ["sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
_NEAR = "near array<struct<t_id: long, tx: double, ty: double, tz: double, d2: double>>"


def _plus(at: Column) -> Callable[[Column], Column]:
    return lambda step: at + step


def _queries(queries: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Queries as (key, q_id, qx, qy, qz) with the tile that they lie in."""
    at = {u: F.floor(F.col(a) / (WIDE * radius)).cast("long") for u, a in zip(TILE, "xyz")}
    return queries.select(*keys, F.col("pt_id").alias("q_id"), *(F.col(a).alias("q" + a) for a in "xyz"), *(v.alias(u) for u, v in at.items()))


def _targets(targets: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Targets as (key, t_id, tx, ty, tz), once for every tile within the radius."""
    t = targets.select(*keys, F.col("pt_id").alias("t_id"), *(F.col(a).alias("t" + a) for a in "xyz"))
    for u, a in zip(TILE, "xyz"):
        reach = radius + 1e-9 * (radius + F.abs("t" + a))
        low, high = (F.floor((F.col("t" + a) + side * reach) / (WIDE * radius)).cast("long") for side in (-1, 1))
        t = t.withColumn(u, F.explode(F.sequence(low, high)))
    return t


def _close(radius: float) -> Column:
    return G.sq_distance(G.vec("q"), G.vec("t")) < radius * radius


def within(queries: DataFrame, targets: DataFrame, radius: float, key: str | None = "map_key") -> DataFrame:
    """Pairs (q_id, qx, qy, qz, t_id, tx, ty, tz, d2) with a squared distance under radius². Both sides: the key where there is one, pt_id, x, y, z.

    The join keeps none but these pairs. Down-sample first where tiles are dense.
    """
    keys = [key] if key else []
    pairs = _queries(queries, radius, keys).join(_targets(targets, radius, keys), [*keys, *TILE]).where(_close(radius))
    return pairs.withColumn("d2", G.sq_distance(G.vec("q"), G.vec("t"))).drop(*keys, *TILE)


def nearest(queries: DataFrame, targets: DataFrame, k: int, radius: float, key: str | None = "map_key", complete: bool = False) -> DataFrame:
    """The k nearest targets inside the radius, ranked by (d2, t_id): pairs with nr. complete: only queries that have all k. A query's pt_id is its own."""
    sets = nearest_sets(queries, targets, k, radius, key, complete)
    pairs = sets.select("q_id", "qx", "qy", "qz", F.posexplode("near").alias("nr", "_t"))
    return pairs.select("q_id", "qx", "qy", "qz", "_t.*", (F.col("nr") + 1).alias("nr"))


def nearest_sets(
    queries: DataFrame, targets: DataFrame, k: int, radius: float, key: str | None = "map_key", complete: bool = False, sums: bool = False, crowd: int = 4096, split: Callable[[DataFrame, DataFrame, list[str]], DataFrame] | None = None,
    whole: int = WHOLE, by: str | None = None, in_order: bool = False,
) -> DataFrame:
    """As `nearest`, one row per query that has a target: q_id, qx, qy, qz and near, its targets (t_id, tx, ty, tz, d2) in order; sums adds their number n and the sums of their coordinates and products; by adds that column of the queries.

    The points of a key of up to `whole` queries and targets meet as they are, each shuffled once. Those of larger keys go by tiles: a tile's queries and targets meet as two lists in one row, so no pair is shuffled or sorted.
    Tiles with over `crowd` queries or targets are no lists: their points meet cell by cell and all pairs of a query are ranked, with the same result; with `split`, it finds their ranked pairs, of both sides and the columns
    that name a tile. in_order: the sets of like keys follow each other.
    """
    if key and whole:
        full = crowded([queries, targets], key, whole)
        sides = [queries, targets] if full is None else [side.join(F.broadcast(full), key, "left_anti") for side in (queries, targets)]
        out = _sets_of_keys(*sides, k, radius, key, complete, sums, by, in_order)
        if full is None:
            return out
        sides = [side.join(F.broadcast(full), key, "left_semi") for side in (queries, targets)]
        return out.unionByName(nearest_sets(*sides, k, radius, key, complete, sums, crowd, split, 0, by))
    if by:
        return nearest_sets(queries, targets, k, radius, key, complete, sums, crowd, split, 0).join(queries.select(F.col("pt_id").cast("long").alias("q_id"), by), "q_id")
    keys = [key] if key else []
    on = [*keys, *TILE]
    q, t = _queries(queries, radius, keys), _targets(targets, radius, keys)
    full = [side.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*on) for side in (q, t)]
    full = staged(full[0].unionByName(full[1]).where(" AND ".join(f"{c} IS NOT NULL" for c in on)).distinct(), "crowded")
    dense = not full.isEmpty()
    sides = [side.join(F.broadcast(full), on, "left_anti") if dense else side for side in (q, t)]
    lists = [side.repartition(*on).groupBy(*on).agg(F.collect_list(F.struct(F.col(s + "_id").cast("long").alias("id"), *(F.col(s + a).cast("double").alias(a) for a in "xyz"))).alias(s)) for side, s in zip(sides, "qt")]
    out = lists[0].join(lists[1], on).select("q", "t").mapInArrow(_closest(k, radius, complete, sums), f"q_id long, qx double, qy double, qz double, {_NEAR}{_numbers(sums)}")
    if not dense:
        return out
    q, t = (side.join(F.broadcast(full), on, "left_semi") for side in (q, t))
    return out.unionByName(_sets(split(q, t, on) if split else _ranked(q, t, k, radius, on), k, complete, sums))


def _sets_of_keys(queries: DataFrame, targets: DataFrame, k: int, radius: float, key: str, complete: bool, sums: bool, by: str | None, in_order: bool) -> DataFrame:
    """nearest_sets of keys whose points are searched whole."""
    place = [F.col("pt_id").cast("long").alias("pt_id"), *(F.col(a).cast("double").alias(a) for a in "xyz")]
    extra = [F.col(by).alias("_by")] if by else []
    kind = f", {by} {queries.schema[by].dataType.simpleString()}" if by else ""

    def work(_: object, sides: list[Columns]) -> Iterator[dict]:
        q, t = sides
        out, some = _found(q, t, k, radius, complete, sums)
        if by and len(some):
            out[by] = pa.array(q["_by"][some])
        if len(some):
            yield out

    return together([queries.select(key, *place, *extra), targets.select(key, *place)], key, work, f"q_id long, qx double, qy double, qz double, {_NEAR}{_numbers(sums)}{kind}", in_order)


def _found(q: Columns, t: Columns, k: int, radius: float, complete: bool, sums: bool) -> tuple[dict, np.ndarray]:
    """Columns of nearest_sets for the queries q among t (pt_id, x, y, z), and which queries have a row."""
    if not len(q["pt_id"]) or not len(t["pt_id"]):
        return {}, np.empty(0, np.int64)
    at, d2, have = nearest_in([q[a] for a in "xyz"], t["pt_id"], [t[a] for a in "xyz"], k, radius)
    some = np.flatnonzero(have == k) if complete else np.flatnonzero(have)
    row, rank = np.nonzero(np.isfinite(d2[some]))
    col, d2, have = at[some][row, rank], d2[some][row, rank], have[some]
    at = [t[a][col] for a in "xyz"]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(have)], pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in (t["pt_id"][col], *at, d2)], ["t_id", "tx", "ty", "tz", "d2"]))
    out = {"q_id": pa.array(q["pt_id"][some]), **{"q" + a: pa.array(q[a][some]) for a in "xyz"}, "near": lists}
    if sums:
        v = dict(zip("xyz", at))
        out |= {"n": pa.array(have.astype(np.int64)), **{s: pa.array(np.bincount(row, v[s[1]] if len(s) == 2 else v[s[1]] * v[s[2]], len(some))) for s in _SUMS}}  # in order of rank, as a window's rows add up
    return out, some


def sample_sets(points: DataFrame, leaf: float, k: int, radius: float, key: str | None = None, whole: int = WHOLE) -> DataFrame:
    """nearest_sets (complete, with sums and the key) of the voxel samples of points among all points. Samples of a key of up to `whole` points are picked and searched in one group, so that its points are shuffled once."""
    full = crowded([points], key, whole) if key and whole else None
    if not key or not whole or full is not None:
        on = points.join(F.broadcast(full), key, "left_semi") if full is not None else points
        seeds = staged(voxel_samples(on, leaf, (key,) if key else ()), "seeds")
        out = nearest_sets(seeds, on, k, radius, key, complete=True, sums=True, whole=whole, by=key)
        if full is None:
            return out
        rest = points.join(F.broadcast(full), key, "left_anti")
        return out.unionByName(_samples_of_keys(rest, leaf, k, radius, key))
    return _samples_of_keys(points, leaf, k, radius, key)


def _samples_of_keys(points: DataFrame, leaf: float, k: int, radius: float, key: str) -> DataFrame:
    def work(at: object, sides: list[Columns]) -> Iterator[dict]:
        t = sides[0]
        t = {c: v[np.isfinite(t["x"] + t["y"] + t["z"])] for c, v in t.items()}
        cell = [np.floor(t[a] / leaf) for a in "xyz"]
        off = [(t[a] - (c + 0.5) * leaf) for a, c in zip("xyz", cell)]
        order = np.lexsort((t["pt_id"], off[0] * off[0] + off[1] * off[1] + off[2] * off[2], *cell))
        first = np.r_[True, (np.diff([c[order] for c in cell]) != 0).any(axis=0)][: len(order)]
        out, some = _found({c: v[order[first]] for c, v in t.items()}, t, k, radius, True, True)
        if len(some):
            yield out | {key: pa.array([at] * len(some))}

    held = points.select(key, F.col("pt_id").cast("long").alias("pt_id"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    kind = points.schema[key].dataType
    out = together([held], key, work, f"q_id long, qx double, qy double, qz double, {_NEAR}{_numbers(True)}, {key} {'long' if kind.simpleString() == 'int' else kind.simpleString()}")
    return out.withColumn(key, F.col(key).cast(kind))


def _numbers(sums: bool) -> str:
    return (", n long, " + ", ".join(f"{s} double" for s in _SUMS)) if sums else ""


def _ranked(q: DataFrame, t: DataFrame, k: int, radius: float, on: list[str]) -> DataFrame:
    """Ranked pairs of crowded tiles: a query goes to the 27 cells around it, and its pairs are ranked by a window."""
    at = lambda side: [F.floor(F.col(side + a) / radius).cast("long").alias(v) for a, v in zip("xyz", CELL)]
    q, t = q.select("*", *at("q")), t.select("*", *at("t"))
    step = F.array(*(F.lit(j).cast("long") for j in (-1, 0, 1)))
    for v in CELL:
        q = q.withColumn(v, F.explode(F.transform(step, _plus(F.col(v)))))
    pairs = q.join(t, [*on, *CELL]).where(_close(radius)).withColumn("d2", G.sq_distance(G.vec("q"), G.vec("t")))
    return pairs.withColumn("nr", F.row_number().over(Window.partitionBy("q_id").orderBy("d2", "t_id"))).where(F.col("nr") <= k)


def _sets(pairs: DataFrame, k: int, complete: bool, sums: bool) -> DataFrame:
    """Ranked pairs as nearest_sets gives them."""
    v = dict(zip("xyz", G.vec("t")))
    total = [F.count("*").alias("n"), *(F.sum(v[s[1]] if len(s) == 2 else v[s[1]] * v[s[2]]).alias(s) for s in _SUMS)]
    out = pairs.groupBy("q_id", "qx", "qy", "qz").agg(F.array_sort(F.collect_list(F.struct("nr", "t_id", "tx", "ty", "tz", "d2"))).alias("near"), *total)
    out = out.withColumn("near", F.transform("near", lambda x: F.struct(*(x[c].alias(c) for c in ("t_id", "tx", "ty", "tz", "d2")))))
    out = out.where(F.col("n") == k) if complete else out
    return out if sums else out.drop("n", *_SUMS)


def _closest(k: int, radius: float, complete: bool, sums: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each row's list q the k nearest of its list t inside the radius. Distances are taken a slice of queries at a time."""

    def search(qp: list[np.ndarray], t_id: np.ndarray, tp: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.zeros((len(qp[0]), len(t_id)))
        for a, b in zip(qp, tp):
            off = a[:, None] - b
            off *= off
            d += off
        bound = d < radius * radius
        if len(t_id) > k:
            bound &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]  # ties of the k-th stay until ranked
        row, col = np.nonzero(bound)
        near = d[row, col]
        order = np.lexsort((t_id[col], near, row))
        row, col, near = row[order], col[order], near[order]
        have = np.bincount(row, minlength=len(d))
        keep = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have) < k
        return row[keep], col[keep], near[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = batch.column("q"), batch.column("t")
            (q_from, q_all), (t_from, t_all) = ((c.offsets.to_numpy(), c.values) for c in (q, t))
            q_id, t_id = (c.field("id").to_numpy(zero_copy_only=True) for c in (q_all, t_all))
            qp, tp = ([c.field(a).to_numpy(zero_copy_only=True) for a in "xyz"] for c in (q_all, t_all))
            rows, cols, near = [], [], []
            for i in range(batch.num_rows):
                c, d = t_from[i], t_from[i + 1]
                size = max(1, 1_000_000 // max(1, d - c))
                for a in range(q_from[i], q_from[i + 1], size):
                    b = min(a + size, q_from[i + 1])
                    r, at, d2 = search([v[a:b] for v in qp], t_id[c:d], [v[c:d] for v in tp])
                    rows.append(r + a)
                    cols.append(at + c)
                    near.append(d2)
            row, col, d2 = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((rows, np.int64), (cols, np.int64), (near, float)))
            have = np.bincount(row, minlength=len(q_id))
            if complete:
                keep = have[row] == k
                row, col, d2 = row[keep], col[keep], d2[keep]
                have[have != k] = 0
            some = np.flatnonzero(have)
            if not len(some):
                continue
            ends = np.concatenate(([0], np.cumsum(have[some])))
            at = [v[col] for v in tp]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in (t_id[col], *at, d2)], ["t_id", "tx", "ty", "tz", "d2"]))
            out = {"q_id": pa.array(q_id[some]), **{"q" + a: pa.array(v[some]) for a, v in zip("xyz", qp)}, "near": lists}
            if sums:
                v, of = dict(zip("xyz", at)), np.repeat(np.arange(len(some)), have[some])
                out |= {"n": pa.array(have[some].astype(np.int64)), **{s: pa.array(np.bincount(of, v[s[1]] if len(s) == 2 else v[s[1]] * v[s[2]])) for s in _SUMS}}  # in order of rank, as a window's rows add up
            yield pa.RecordBatch.from_pydict(out)

    return run


def _tree(targets: DataFrame, radius: float, crowd: int, depth: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Targets with the cell they lie in (level, cell), and all cells with their number of points (n) and whether they are split (inner).

    A cell of level l is radius / 2^l wide. One of over `crowd` points is split into eight, down to `depth`; only the points of split cells meet the next level.
    """
    rest, placed, known = targets, None, None
    for level in range(depth + 1):
        on = cells(rest, radius / 2**level)
        n = on.groupBy(*keys, *CELL).agg(F.count("*").alias("n")).withColumns({"level": F.lit(level), "inner": (F.col("n") > crowd) if level < depth else F.lit(False)})
        n = staged(n, "cells")
        known = n if known is None else known.unionByName(n)
        split = n.where("inner").select(*keys, *CELL)
        done = on.join(n.where("NOT inner").select(*keys, *CELL, "level"), [*keys, *CELL])
        placed = done if placed is None else placed.unionByName(done)
        if split.isEmpty():
            break
        rest = staged(on.join(split, [*keys, *CELL], "left_semi").drop(*CELL), "crowded")
    return placed, known


def nearest_uneven(queries: DataFrame, targets: DataFrame, k: int, radius: float, key: str | None = "map_key", complete: bool = False, crowd: int = 64, depth: int = 12, whole: int = 4096) -> DataFrame:
    """As `nearest`, for targets of uneven density. Keys and tiles of up to `whole` queries and targets are searched as in nearest_sets, and only the points of more crowded tiles are dealt to cells that are split.

    So no query meets more than `whole` points, and the rows that go from level to level are those of crowded tiles alone.
    """

    def split(q: DataFrame, t: DataFrame, on: list[str]) -> DataFrame:
        sides = [side.select(*on, F.col(s + "_id").alias("pt_id"), *(F.col(s + a).alias(a) for a in "xyz")) for side, s in ((q, "q"), (t, "t"))]
        return _split_cells(*sides, k, radius, on, crowd, depth)

    sets = nearest_sets(queries, targets, k, radius, key, complete, crowd=whole, split=split, whole=whole)
    pairs = sets.select("q_id", "qx", "qy", "qz", F.posexplode("near").alias("nr", "_t"))
    return pairs.select("q_id", "qx", "qy", "qz", "_t.*", (F.col("nr") + 1).alias("nr"))


def _split_cells(queries: DataFrame, targets: DataFrame, k: int, radius: float, keys: list[str], crowd: int, depth: int) -> DataFrame:
    """Ranked pairs of crowded tiles: no pair is made with a point that k nearer ones are known to precede.

    Cells of over `crowd` points are split (see `_tree`). A query starts from the 27 cells around it and the numbers of points in them: as soon as the cells whose far corners lie within some distance hold k points, cells whose
    near corners lie farther go. Split cells that are left give way to their parts, level by level, and only the points of what is left in the end meet the query. Of targets at one
    place only the k of smallest pt_id take part, so that no cell holds more than k copies of a point that no split can part.
    """
    same = Window.partitionBy(*keys, "x", "y", "z").orderBy("pt_id")
    targets = targets.select(*keys, "pt_id", "x", "y", "z").withColumn("_nr", F.row_number().over(same)).where(F.col("_nr") <= k).drop("_nr")
    placed, known = _tree(targets, radius, crowd, depth, keys)
    q = cells(queries, radius).select(*keys, F.col("pt_id").alias("q_id"), *(F.col(a).alias("q" + a) for a in "xyz"), *CELL)
    step = F.array(*(F.lit(j).cast("long") for j in (-1, 0, 1)))
    for v in CELL:
        q = q.withColumn(v, F.explode(F.transform(step, _plus(F.col(v)))))
    open_ = q.withColumn("level", F.lit(0)).join(known, [*keys, "level", *CELL])
    size = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
    slack = 1e-9 * (radius + sum((F.abs("q" + a) for a in "yz"), F.abs("qx")))
    low, high = {}, {}
    for a, v in zip("xyz", CELL):
        left, right = F.col(v) * size - F.col("q" + a), (F.col(v) + 1) * size - F.col("q" + a)
        low[a], high[a] = F.greatest(left, -right, F.lit(0.0)), F.greatest(F.abs(left), F.abs(right))
    near, far = G.norm(*low.values()) - slack, G.norm(*high.values()) + slack
    by_far = Window.partitionBy("q_id").orderBy("far").rangeBetween(Window.unboundedPreceding, 0)
    for _ in range(depth + 1):
        on = open_.withColumns({"near": near, "far": far}).where(F.col("near") < radius)
        on = on.withColumn("have", F.sum("n").over(by_far))
        bound = F.min(F.when(F.col("have") >= k, F.col("far"))).over(Window.partitionBy("q_id"))
        on = staged(on.withColumn("bound", bound).where("bound IS NULL OR near <= bound").drop("near", "far", "have", "bound"), "frontier")
        if on.where("inner").isEmpty():
            break
        parts = on.where("inner").drop("n", "inner").withColumn("level", F.col("level") + 1)
        for v in CELL:
            parts = parts.withColumn(v, F.explode(F.array(F.col(v) * 2, F.col(v) * 2 + 1)))
        open_ = on.where("NOT inner").unionByName(parts.join(known, [*keys, "level", *CELL]))
    t = placed.select(*keys, "level", *CELL, F.col("pt_id").alias("t_id"), *(F.col(a).alias("t" + a) for a in "xyz"))
    pairs = on.drop("n", "inner").join(t, [*keys, "level", *CELL]).withColumn("d2", G.sq_distance(G.vec("q"), G.vec("t"))).where(F.col("d2") < radius * radius).drop(*keys, *CELL, "level")
    return pairs.withColumn("nr", F.row_number().over(Window.partitionBy("q_id").orderBy("d2", "t_id"))).where(F.col("nr") <= k)


def new_points(queries: DataFrame, targets: DataFrame, radius: float, key: str | None = "map_key") -> DataFrame:
    """Queries without any target inside the radius. A query is done with at its first target."""
    keys = [key] if key else []
    t = _targets(targets, radius, keys).select(*(F.col(c).alias("_" + c) for c in [*keys, *TILE]), "tx", "ty", "tz")
    q = queries.withColumns({"q" + a: F.col(a) for a in "xyz"} | {u: F.floor(F.col(a) / (WIDE * radius)).cast("long") for u, a in zip(TILE, "xyz")})
    same = [F.col(c) == F.col("_" + c) for c in [*keys, *TILE]]
    return q.join(t, [*same, _close(radius)], "left_anti").select(queries.columns)


def refresh(targets: DataFrame, queries: DataFrame, radius: float, ts: str = "ts", key: str | None = "map_key") -> DataFrame:
    """targets with the newest time of the queries whose nearest target they are."""
    hit = nearest(queries, targets, 1, radius, key).select("q_id", "t_id").join(queries.select(F.col("pt_id").alias("q_id"), F.col(ts).alias("__ts")), "q_id")
    hit = hit.groupBy(F.col("t_id").alias("pt_id")).agg(F.max("__ts").alias("__ts"))
    return targets.join(hit, "pt_id", "left").withColumn(ts, F.greatest(ts, "__ts")).drop("__ts")


def overlap(queries: DataFrame, targets: DataFrame, radius: float, limit: float = 0.5, key: str | None = "map_key", by: str = "frame_id") -> DataFrame:
    """Per frame: points, new points and their share; bad where the share is over the limit."""
    new = new_points(queries, targets, radius, key).groupBy(by).agg(F.count("*").alias("n_new"))
    out = queries.groupBy(by).agg(F.count("*").alias("n")).join(new, by, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return out.withColumn("share_new", F.col("n_new") / F.col("n")).withColumn("bad", F.col("share_new") > limit)


def fitness(queries: DataFrame, targets: DataFrame, radius: float, key: str | None = "map_key", by: str = "frame_id") -> DataFrame:
    """Mean squared distance to the nearest target inside the radius, per frame."""
    near = nearest(queries, targets, 1, radius, key).select(F.col("q_id").alias("pt_id"), "d2")
    return queries.select(by, "pt_id").join(near, "pt_id").groupBy(by).agg(F.avg("d2").alias("fitness"), F.count("*").alias("matched"))
