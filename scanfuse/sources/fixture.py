"""The room scene: point clouds, poses and scenarios that Spark derives from `lineitem` and `events`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.operators.components import staged

#: Portable SQL of the scene; `p` is the point table. The same text serves the oracles.
POINTS = """k AS (
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn
 FROM {lineitem}),
g AS (
 SELECT CAST(floor(l_orderkey/750.0) AS INT) AS frame_id, l_orderkey*64+rn AS pt_id,
  CAST((l_partkey*7+l_linenumber) % 16 AS INT) AS ring,
  CAST((l_suppkey*13+l_partkey*31+l_linenumber*101+l_orderkey*17) % 180 AS INT) AS az, l_discount, l_quantity FROM k),
r AS (
 SELECT frame_id, pt_id, ring, az, l_quantity AS intensity, radians(-15.0+2.0*ring) AS el, radians(2.0*az) AS th,
  (l_discount-0.05)*0.2 AS noise FROM g),
d AS (SELECT *, least(12.0/greatest(abs(cos(th)),1e-9), 8.0/greatest(abs(sin(th)),1e-9)) AS rxy FROM r),
e AS (
 SELECT *, least(rxy/cos(el), CASE WHEN el<0 THEN 1.8/abs(sin(el)) ELSE 1e9 END)
  * CASE WHEN az BETWEEN 40 AND 47 AND ring>=6 AND frame_id%2=1 THEN 0.6 ELSE 1.0 END + noise AS rng FROM d),
p AS (SELECT frame_id, pt_id, rng*cos(el)*cos(th) AS x, rng*cos(el)*sin(th) AS y, rng*sin(el) AS z, intensity, ring, az FROM e)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_READY: dict[tuple[str, str], DataFrame] = {}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, pt_id, x, y, z, intensity, ring, az: derived from `lineitem` once per application and written to the shared folder as a point table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _READY:
        _READY[key] = staged(spark.sql(f"WITH {POINTS} SELECT * FROM p", lineitem=read(spark, sf_dir, "lineitem")), "points")
    return _READY[key]


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame_id, ts, tx, ty, tz, qx, qy, qz, qw of every frame; ten frames are a session."""
    f = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 750.0).cast("int").alias("frame_id")).distinct()
    at = F.col("frame_id")
    zero = F.lit(0.0)
    return f.select(
        F.floor(at / 10.0).cast("int").alias("session_id"), "frame_id", (0.1 * at).alias("ts"), (0.2 * at).alias("tx"), (0.05 * at).alias("ty"), zero.alias("tz"), zero.alias("qx"), zero.alias("qy"),
        F.sin(0.01 * at).alias("qz"), F.cos(0.01 * at).alias("qw"),
    )


POSES = """ps AS (SELECT CAST(floor(f/10.0) AS INT) AS session_id, f AS frame_id, 0.1*f AS ts, 0.2*f AS tx, 0.05*f AS ty, 0.0 AS tz, 0.0 AS qx, 0.0 AS qy, sin(0.01*f) AS qz, cos(0.01*f) AS qw
 FROM (SELECT DISTINCT CAST(floor(l_orderkey/750.0) AS INT) AS f FROM lineitem) fr)"""

#: Range pixels of the scene.
PIXELS = """px0 AS (SELECT *, CAST(floor((degrees(atan2(z, sqrt(x*x+y*y)))+15.1)/2.0) AS INT) AS row_id, CAST(-round((degrees(atan2(x,y))-90.0)/2.0)+90 AS INT) AS c0, sqrt(x*x+y*y+z*z) AS rng FROM p),
px AS (SELECT frame_id, pt_id, x, y, z, intensity, ring, row_id, CASE WHEN c0>=180 THEN c0-180 ELSE c0 END AS col_id, rng FROM px0 WHERE row_id BETWEEN 0 AND 15),
img AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id,row_id,col_id ORDER BY rng, pt_id) AS nr FROM px) q WHERE nr=1)"""


def _plain_zeros(sql: str) -> str:
    """Adds 0.0 to what is rounded, so that no engine returns a negative zero."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _plain_zeros(sql[start + 6 : end - 1])
        out += sql[at:start] + (f"(round({inner})+0.0)" if inner.endswith((",5", ",8")) else f"round({inner})")
        at = end
    return out + sql[at:]


def r5(*names: str) -> list[Column]:
    """Columns rounded to five places, without negative zeros."""
    return [(F.round(n, 5) + 0.0).alias(n) for n in names]


def r5_off_ties(*names: str) -> list[Column]:
    """As r5, for tables of very many rows: what lies clear of the middle between two fifth decimals is rounded by scaling, with the same result, and the decimal arithmetic of `round` is left to the rest."""
    scaled = [F.col(n) * 1e5 for n in names]
    clear = [(F.abs(v) < 1e9) & (F.abs(v - F.rint(v)) < 0.499) for v in scaled]
    return [(F.when(ok, F.rint(v) / 1e5).otherwise(F.round(n, 5)) + 0.0).alias(n) for n, v, ok in zip(names, scaled, clear)]


def oracle(body: str, *parts: str) -> str:
    """A DuckDB query over the scene: the named common tables, then body."""
    text = {"points": POINTS.replace("{lineitem}", "lineitem"), "poses": POSES, "pixels": PIXELS}
    return ("WITH " + ",\n".join(text.get(x, x) for x in parts) + "\n" if parts else "") + _plain_zeros(body)
