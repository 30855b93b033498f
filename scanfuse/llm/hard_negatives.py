"""Hard-negative mining over a multiway hyperplane tree with distance ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfuse.llm.common import staged, table
from scanfuse.llm.vectors import is_query, matrix, met, quantised, runs, shown_id, stacked

#: No score is below.
LOWEST = -(1 << 62)


def spread_points(v: np.ndarray, m: int) -> np.ndarray:
    """Places of up to m points of v, each the farthest from those before it; fewer where v has fewer different points."""
    chosen, near = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(chosen) < m and near.max(initial=0) > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((v - v[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


class Ranges:
    """For split points i and sibling subtrees j: the least and greatest distance from i to the points in j, and the least and greatest squared norm in j."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.low, self.high, self.least, self.most = low, high, least, most

    def may_hold(self, away: np.ndarray, norm: np.ndarray, j: int, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
        """Of queries with distances `away` to the split points: may subtree j hold a score between floor and ceiling?

        A score s of a point x is a distance: |q-x|² = |q|² + |x|² - 2s. So the window is an annulus around the query, and what the triangle
        inequality says of the subtree from every split point's range must meet it. The slack covers rounding.
        """
        outer, inner = norm + self.most[j] - 2.0 * floor, norm + self.least[j] - 2.0 * ceiling
        nearest = np.maximum(np.maximum(away - self.high[:, j], self.low[:, j] - away).max(axis=1), 0)
        farthest = (away + self.high[:, j]).min(axis=1)
        slack = 1e-5 * (1 + np.sqrt(norm + self.most[j]))
        return (outer >= -slack) & (nearest <= np.sqrt(np.maximum(outer, 0)) + slack) & (farthest >= np.sqrt(np.maximum(inner, 0)) - slack)


class Tree:
    """Points of one chunk: inner nodes of up to `ways` split points, a point below its nearest; leaves of at most `leaf` points, or of equal ones."""

    def __init__(self, v: np.ndarray, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, leaf: int = 256, ways: int = 8):
        # products of doubles are exact while sums stay under 2^53
        self.exact = v if np.abs(v).max(initial=0) ** 2 * max(1, v.shape[1]) >= 1 << 53 else None
        self.v, self.row, self.vec_id, self.label = v.astype(np.float64), row, vec_id, label
        self.leaf, self.ways = leaf, ways
        self.root = self._grow(np.arange(len(v)))

    def _grow(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        points = at[spread_points(self.v[at[:: max(1, len(at) // (16 * self.ways))]], self.ways) * max(1, len(at) // (16 * self.ways))]
        d = distances(self.v[at], self.v[points])
        home = d.argmin(axis=1)
        kids = [np.flatnonzero(home == j) for j in range(len(points))]
        kids = [k for k in kids if len(k)]
        if len(kids) < 2:
            return at
        norm = (self.v[at] ** 2).sum(axis=1)
        ranges = Ranges(*(np.array([f(d[k], axis=0) for k in kids]).T for f in (np.min, np.max)), *(np.array([f(norm[k]) for k in kids]) for f in (np.min, np.max)))
        return points, ranges, [self._grow(at[k]) for k in kids]

    def search(self, q: np.ndarray, row: np.ndarray, label: np.ndarray, same: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """The k best (-score, id, row) of each query with floor <= score <= ceiling, of its own label or of others, and better than (kth, kth_id), which rise on the way. The query's own row is left out."""
        best: list[list[tuple[int, int, int]]] = [[] for _ in q]
        x, kth, kth_id = q.astype(np.float64), np.maximum(kth, floor - 1), kth_id.copy()
        norm = (x * x).sum(axis=1)

        def down(node, who: np.ndarray) -> None:
            if isinstance(node, tuple):
                points, ranges, kids = node
                away = distances(x[who], self.v[points])
                for j, kid in enumerate(kids):
                    on = ranges.may_hold(away, norm[who], j, np.maximum(floor, kth)[who], ceiling[who])
                    if on.any():
                        down(kid, who[on])
                return
            s = (x[who] @ self.v[node].T).astype(np.int64) if self.exact is None else q[who] @ self.exact[node].T
            ids = self.vec_id[node]
            ok = (s > kth[who][:, None]) | ((s == kth[who][:, None]) & (ids[None] < kth_id[who][:, None]))
            ok &= (s >= floor[who][:, None]) & (s <= ceiling[who][:, None]) & ((self.label[node][None] == label[who][:, None]) == same[who][:, None]) & (self.row[node][None] != row[who][:, None])
            for a in np.flatnonzero(ok.any(axis=1)).tolist():
                hits = np.flatnonzero(ok[a])
                if len(hits) > k:
                    hits = hits[np.lexsort((ids[hits], -s[a, hits]))[:k]]
                w = who[a]
                best[w] = sorted([*best[w], *zip((-s[a, hits]).tolist(), ids[hits].tolist(), self.row[node][hits].tolist())])[:k]
                if len(best[w]) == k and (-best[w][-1][0] > kth[w] or (-best[w][-1][0] == kth[w] and best[w][-1][1] < kth_id[w])):
                    kth[w], kth_id[w] = -best[w][-1][0], best[w][-1][1]

        if len(self.v):
            down(self.root, np.arange(len(q)))
        return best


_ROW = "block int, row long, vec_id long, label int, v array<int>"
_ASK = {"pos": "long", "same": "boolean", "floor": "long", "ceiling": "long", "kth": "long", "kth_id": "long"}
_HIT = "row long, pos long, nr int, hit_row long, hit_id long, score long"


class Forest:
    """All rows (row, vec_id, label, v) under one top node of `ways` split points, each subtree in chunks of about `chunk_rows`.

    Split points come from a sample of at most `sample` rows, those of the least hashes of their row numbers; every row is indexed, below its nearest split point. The distance
    ranges of all split points to all subtrees are grouped sums over all rows, ways² of them. A subtree that holds much of the rows, as one of equal vectors does, has more chunks. A chunk is a tree of
    its own, grown in the task that searches it. A search takes each query to the chunk of its own row first, then with the bound found there to those of other subtrees that the ranges do not rule out.
    """

    def __init__(self, rows: DataFrame, ways: int = 32, sample: int = 2048, chunk_rows: int = 1 << 14):
        seeds = rows.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(sample).toArrow()
        self.empty = not seeds.num_rows
        if self.empty:
            return
        v = matrix(seeds.column("v")).astype(np.float64)
        points = self.points = v[spread_points(v, ways)]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                away = distances(*fitted(matrix(b.column("v")).astype(np.float64), points))
                yield b.append_column("home", pa.array(away.argmin(axis=1).astype(np.int32)))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, home = matrix(b.column("v")).astype(np.float64), b.column("home").to_numpy()
                away, norm = distances(*fitted(x, points)), (x * x).sum(axis=1)
                for j in np.unique(home).tolist():
                    on = home == j
                    d = away[on]
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([int(on.sum())]), *(pa.array([c.tolist()]) for c in (d.min(axis=0), d.max(axis=0))), pa.array([norm[on].min()]), pa.array([norm[on].max()])], ["home", "n", "low", "high", "least", "most"])

        homes = staged(rows.select("row", "vec_id", "label", "v").mapInArrow(place, "row long, vec_id long, label int, v array<int>, home int"), "homes")
        by_batch = homes.mapInArrow(measure, "home int, n long, low array<double>, high array<double>, least double, most double")
        each = by_batch.select("home", "n", "least", "most", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
        got = each.groupBy("home", "i").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas()
        m = len(points)
        low, high, least, most, n = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf), np.zeros(m, np.int64)
        low[got["i"], got["home"]], high[got["i"], got["home"]] = got["low"], got["high"]
        least[got["home"]], most[got["home"]], n[got["home"]] = got["least"], got["most"], got["n"]
        self.ranges, self.full = Ranges(low, high, least, most), np.flatnonzero(n)
        self.chunks = np.maximum(1, -(-n // chunk_rows))
        self.first = np.concatenate([[0], np.cumsum(self.chunks)])
        at = lambda a: F.element_at(F.array(*(F.lit(int(x)) for x in a)), F.col("home") + 1)
        self.rows = homes.withColumn("block", (at(self.first[:-1]) + F.pmod(F.xxhash64("row"), at(self.chunks))).cast("int"))

    def _reach(self, queries: DataFrame) -> DataFrame:
        """Queries with the chunks (to) that may hold what they seek."""
        points, ranges, full, first = self.points, self.ranges, self.full, self.first

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = fitted(matrix(b.column("v")).astype(np.float64), points)
                away, norm = distances(x, at), (x * x).sum(axis=1)
                floor, ceiling = np.maximum(b.column("floor").to_numpy(), b.column("kth").to_numpy()), b.column("ceiling").to_numpy()
                on = np.array([ranges.may_hold(away, norm, j, floor, ceiling) for j in full])
                to = [np.concatenate([np.arange(first[j], first[j + 1]) for j in full[on[:, k]]] or [[]]).astype(int).tolist() for k in range(len(x))]
                yield b.append_column("to", pa.array(to, pa.list_(pa.int32())))

        return queries.select("block", "row", "vec_id", "label", "v", *_ASK).mapInArrow(reach, f"{_ROW}, {', '.join(f'{k} {t}' for k, t in _ASK.items())}, to array<int>")

    def _visit(self, queries: DataFrame, k: int) -> DataFrame:
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, parts, tree = None, [], None
            for at, asks, b in runs(batches):
                if at != block:
                    block, parts, tree = at, [], None
                col = lambda name, b=b: b.column(name).to_numpy(zero_copy_only=False)
                v = matrix(b.column("v"))
                if not asks:
                    parts.append((v, col("row"), col("vec_id"), col("label")))
                    continue
                if not parts:
                    continue
                if tree is None:
                    tree = Tree(stacked([p[0] for p in parts]), *(np.concatenate([p[j] for p in parts]) for j in (1, 2, 3)))
                    parts = parts[:1]
                row, pos = col("row"), col("pos")
                width = tree.v.shape[1]  # what only one side has adds nothing to a product, but the norm counts
                if v.shape[1] > width:
                    tree = Tree(stacked([tree.v.astype(np.int64)], v.shape[1]), tree.row, tree.vec_id, tree.label)
                found = tree.search(stacked([v], width), row, col("label"), col("same"), col("floor"), col("ceiling"), k, col("kth"), col("kth_id"))
                out = [(int(row[a]), int(pos[a]), nr + 1, r, i, -s) for a, hits in enumerate(found) for nr, (s, i, r) in enumerate(hits)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["row", "pos", "nr", "hit_row", "hit_id", "score"])

        rows = self.rows.select("block", "row", "vec_id", "label", "v", *(F.lit(None).cast(t).alias(c) for c, t in _ASK.items()))
        return met(rows, queries.select(*rows.columns), int(self.first[-1])).mapInArrow(visit, _HIT)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: row, pos (with it the key of a query), same, floor, ceiling. Returns row, pos, nr (1 to k), hit_row, hit_id, score: the k best rows, by score and then vec_id."""
        asks = queries.join(self.rows, "row").select("block", "row", "vec_id", "label", "v", "pos", "same", "floor", "ceiling", F.lit(LOWEST).alias("kth"), F.lit((1 << 63) - 1).alias("kth_id"))
        asks = staged(asks, "asks")
        own = staged(self._visit(asks, k), "hits")
        bound = own.where(F.col("nr") == k).select("row", "pos", F.col("score").alias("kth_"), F.col("hit_id").alias("kth_id_"))
        rest = asks.join(bound, ["row", "pos"], "left").withColumns({"kth": F.coalesce("kth_", "kth"), "kth_id": F.coalesce("kth_id_", "kth_id")}).drop("kth_", "kth_id_")
        rest = self._reach(rest).withColumn("there", F.explode("to")).where("there <> block").withColumn("block", F.col("there"))
        w = Window.partitionBy("row", "pos").orderBy(F.desc("score"), "hit_id", "hit_row")
        return own.unionByName(self._visit(rest, k)).withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= k)


def fitted(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as wide as the wider."""
    width = max(x.shape[1], points.shape[1])
    return stacked([x], width), stacked([points], width)


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (4, 5), **tree: int) -> DataFrame:
    """For each anchor and each of its best `positives` other rows of its label: the best `negatives` rows of other labels that score at most as the positive and at least ratio of it.

    rows: row, vec_id, label, v, as `quantised` returns them, labels not null; anchors: row, those of them that ask. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. Scores are inner products; ties go to the smaller vec_id, null ones last. Rows that repeat a vec_id are rows of their own; only the anchor's own row never counts as its positive.
    A positive of negative score has an empty window. Fewer rows than asked: all. An empty table gives an empty result.
    """
    forest = Forest(rows, **tree)
    if forest.empty:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asks = anchors.select("row", F.lit(0).cast("long").alias("pos"), F.lit(True).alias("same"), F.lit(LOWEST).alias("floor"), F.lit(-LOWEST).alias("ceiling"))
    pos = staged(forest.search(asks, positives).select("row", F.col("hit_row").alias("pos"), F.col("hit_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"({ratio[0]} * positive_score + {ratio[1] - 1}) div {ratio[1]}")
    windows = pos.where("positive_score >= 0").select("row", "pos", F.lit(False).alias("same"), least.alias("floor"), F.col("positive_score").alias("ceiling"))
    found = forest.search(windows, negatives).join(pos, ["row", "pos"]).join(rows.select("row", "vec_id"), "row")
    return found.select(shown_id("vec_id").alias("anchor_id"), shown_id("positive_id").alias("positive_id"), F.col("nr").alias("rank"), shown_id("hit_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = quantised(table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), 256, "vectors", label=label)
    return mine_hard_negatives(rows, rows.where(is_query(100)))


ORACLE = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS anchor_id, q.label = c.label AS same, c.r AS cr, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
 FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS nr FROM s WHERE same) x WHERE nr <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
 row_number() OVER (PARTITION BY p.r, p.cr ORDER BY s.score DESC, s.vec_id, s.cr) AS rank FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
