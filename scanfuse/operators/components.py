"""Staged tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where the setting is unset, a temporary one on a local master, as in tests; an error on a cluster, whose machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def staged(df: DataFrame, label: str, dictionary: bool = True) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    dictionary=False spares tables whose values hardly repeat the attempt to encode them so.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in frames:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class UnionFind:
    """Over 0 … n-1; the root is the smallest index of its set."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def join_all(self, left: np.ndarray, right: np.ndarray) -> None:
        """Vectorised: hooks the larger root onto the smaller and flattens, until every edge is inside one set."""
        while len(left):
            a, b = self.parent[left], self.parent[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.roots()

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p]
            if np.array_equal(up, p):
                return p
            p[:] = up


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges becomes a spanning forest of stars."""
    for pdf in batches:
        ids, at = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
        sets = UnionFind(len(ids))
        sets.join_all(at[: len(pdf)], at[len(pdf) :])
        root = sets.roots()
        far = root != np.arange(len(ids))
        yield pd.DataFrame({"u": ids[far], "v": ids[root[far]]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with edges (u, v) of type long, as distributed union-find.

    Returns node, component (the smallest node reachable) for every node that has an edge to another; loops and null ends are ignored.
    Partial forests shrink the edges inside partitions; then large-star and small-star rounds, each a grouped minimum and a join,
    run until a round changes nothing. No step gathers a component in one task: a hot centre is a join key that only one side repeats.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = staged(e.mapInPandas(_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        done = staged(small.distinct(), "edges")
        discard(e)
        e = done
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _dealt_forest(batches: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """As _forest, of `most` edges at a time."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= most:
            held = list(_forest(iter([pd.concat(held)])))
            n = len(held[0])
            if n >= most // 2:  # hardly smaller: let go
                yield from held
                held, n = [], 0
    if held:
        yield from _forest(iter([pd.concat(held)]))


def near_components(edges: DataFrame) -> DataFrame:
    """As `components`, for graphs whose edges join nodes of like numbers, as points of one session have: the same result, with few edges left to the rounds.

    Edges are dealt by ranges of u. Each part finds a forest of stars; a node goes with the smallest centre that it has. Only centres that a node joins, or that lie under another one, are linked by rounds.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = staged(e.mapInPandas(_dealt_forest, "u long, v long"), "edges")
    stars = staged(e.repartitionByRange("u").mapInPandas(_dealt_forest, "u long, v long"), "stars")
    nodes = staged(stars.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("all")), "nodes")
    discard(e)
    centres = stars.select("v").distinct()
    joined = nodes.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.col("m").alias("v"))
    under = nodes.join(centres.withColumnRenamed("v", "u"), "u", "left_semi").select("u", F.col("m").alias("v"))
    found = components(joined.unionByName(under)).select(F.col("node").alias("m"), "component")
    own = nodes.select(F.col("u").alias("node"), "m").unionByName(centres.join(nodes.select(F.col("u").alias("v")), "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("m")))
    return own.join(found, "m", "left").select("node", F.coalesce("component", "m").alias("component"))
