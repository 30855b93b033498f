"""Point-cloud files, trajectories and packets in and out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: PCD type letters and sizes.
_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 8): "<u8"}
_COLUMNS = ["x", "y", "z", "intensity"]


def parse_pcd(content: bytes) -> pd.DataFrame:
    """x, y, z, intensity (0 where missing) of an ascii or plain binary file."""
    head, at = {}, 0
    while True:
        end = content.index(b"\n", at)
        line = content[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            name, _, rest = line.partition(" ")
            head[name.upper()] = rest.split()
            if name.upper() == "DATA":
                break
    counts = [int(x) for x in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    kinds = [(f, _KINDS[t, int(s)], c) for f, t, s, c in zip(head["FIELDS"], head["TYPE"], head["SIZE"], counts)]
    n = int(head["POINTS"][0])
    if head["DATA"][0] == "ascii":
        rows = np.array([r.split() for r in content[at:].split(b"\n") if r.strip()], dtype=float).reshape(-1, sum(counts))[:n]
        places = np.cumsum([0, *counts])
        data = {f: rows[:, places[k]] for k, (f, _, _) in enumerate(kinds)}
    elif head["DATA"][0] == "binary":
        table = np.frombuffer(content, dtype=[(f"{f}@{k}", t, (c,)) for k, (f, t, c) in enumerate(kinds)], count=n, offset=at)
        data = {f: table[f"{f}@{k}"][:, 0].astype(float) for k, (f, _, _) in enumerate(kinds)}
    else:
        raise ValueError(f"unsupported PCD data: {head['DATA'][0]}")
    return pd.DataFrame({c: data.get(c, np.zeros(n)) for c in _COLUMNS})


def decode_pcd(files: DataFrame) -> DataFrame:
    """path, ts (the number in the file's name, if it is one), pt_id, x, y, z, intensity of files (path, content). One file is one row of work."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                out = parse_pcd(content)
                out.insert(0, "pt_id", np.arange(len(out)))
                out.insert(0, "path", name)
                yield out

    rows = files.select("path", "content").mapInPandas(decode, "path string, pt_id long, x double, y double, z double, intensity double")
    return rows.withColumn("ts", F.expr(r"try_cast(regexp_extract(path, '([0-9]+([.][0-9]+)?)[.]pcd$', 1) AS double)"))


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """As decode_pcd, of the PCD files under path."""
    return decode_pcd(spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").load(path))


def encode_pcd(points: DataFrame, key: str = "frame_id") -> DataFrame:
    """path (`<key>.pcd`) and content of one PCD file per key, its points by pt_id; a scan is what a sensor bounds."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"{pdf[key].iloc[0]}.pcd"], "content": [pcd_bytes(pdf.sort_values("pt_id"))]})

    return points.select(key, "pt_id", *_COLUMNS).groupBy(key).applyInPandas(encode, "path string, content binary")


def pcd_bytes(points: pd.DataFrame, binary: bool = True) -> bytes:
    n = len(points)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {'binary' if binary else 'ascii'}\n"
    rows = points[_COLUMNS].to_numpy(dtype="<f4")
    body = rows.tobytes() if binary else "".join(" ".join(repr(float(v)) for v in r) + "\n" for r in rows).encode()
    return head.encode() + body


def write_map(points: DataFrame, path: str, tile: float = 100.0, files: int = 8) -> None:
    """Points as Parquet, one folder per tile of the plane, each written as up to `files` files, so that a crowded tile is not one task's work."""
    tiles = points.withColumns({"tile_x": F.floor(F.col("x") / tile).cast("int"), "tile_y": F.floor(F.col("y") / tile).cast("int")})
    tiles.repartition("tile_x", "tile_y", F.pmod(F.xxhash64("x", "y", "z"), F.lit(files))).write.partitionBy("tile_x", "tile_y").mode("overwrite").parquet(path)


def read_trajectory(spark: SparkSession, path: str, switch: bool = False) -> DataFrame:
    """ts, tx … qw of text lines `time x y z qx qy qz qw`; switch turns the axes (y, z, x → x, y, z). Broken lines drop; none is doubled."""
    names = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    rows = spark.read.csv(path, sep=" ", schema=", ".join(f"{n} double" for n in names), mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True)
    rows = rows.where("ts IS NOT NULL AND qw IS NOT NULL")
    if switch:
        turned = dict(zip(("tx", "ty", "tz", "qx", "qy", "qz"), ("ty", "tz", "tx", "qy", "qz", "qx")))
        rows = rows.select("ts", *(F.col(turned.get(n, n)).alias(n) for n in names[1:]))
    return rows


def trajectory_lines(poses: DataFrame) -> DataFrame:
    """One column `value`: the text lines of a trajectory."""
    return poses.orderBy("ts").select(F.concat_ws(" ", *(F.col(n).cast("string") for n in ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"))).alias("value"))


def write_trajectory(poses: DataFrame, path: str) -> None:
    trajectory_lines(poses).write.mode("overwrite").text(path)


def livox_packets(points: DataFrame, stamp: str = "frame_id") -> DataFrame:
    """Packets with their points as an array, by pt_id."""
    p = F.array_sort(F.collect_list(F.struct("pt_id", "x", "y", "z", "intensity")))
    return points.groupBy(stamp).agg(F.count("*").alias("point_num"), p.alias("points"))


def flatten_packets(packets: DataFrame, stamp: str = "frame_id", most: int = 32_000) -> DataFrame:
    """A row per point of a packet, with its place; the driver's protocol ends a packet at `most` points."""
    return packets.select(stamp, F.posexplode("points").alias("pos", "_pt")).where(F.col("pos") < most).select(stamp, "pos", "_pt.*")


def build_map(poses: DataFrame, scans: DataFrame, far: float = 70.0) -> DataFrame:
    """The map of a trajectory and its scans (ts): points nearer than `far`, moved by the pose of the same time; scans or poses without a partner drop."""
    from scanfuse.operators.project import range_gate
    from scanfuse.operators.trajectory import transform_points

    return transform_points(range_gate(scans, far), poses, "ts")

