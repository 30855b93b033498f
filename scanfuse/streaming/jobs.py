"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from scanfuse.functions.profile import SensorProfile
from scanfuse.operators import grid, scanline
from scanfuse.operators.project import project


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; a Kafka topic of the same columns fits in its place."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Starts the stream into sink; `every` is a processing-time trigger, else all that is there is taken once."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def frame_pipeline(points: DataFrame, profile: SensorProfile) -> dict[str, DataFrame]:
    """What one micro-batch of whole frames yields: the front surface, its segments and its lines."""
    px = project(points, profile)
    front = grid.front(px)
    cut = scanline.line_segments(front)
    return {"image": front, "segments": cut, "lines": scanline.direction_lines(cut)}


def frames_sink(profile: SensorProfile, out: str) -> Callable[[DataFrame, int], None]:
    """Writes the products of each batch under its number: a repeated batch overwrites itself. The segments are worked out once; the image and the lines come from what was written of them."""

    def write(batch: DataFrame, number: int) -> None:
        to = {name: f"{out}/{name}/batch={number}" for name in ("image", "segments", "lines")}
        made = frame_pipeline(batch, profile)
        made["segments"].write.mode("overwrite").parquet(to["segments"])
        cut = batch.sparkSession.read.schema(made["segments"].schema).parquet(to["segments"])
        cut.select(made["image"].columns).write.mode("overwrite").parquet(to["image"])
        scanline.direction_lines(cut).write.mode("overwrite").parquet(to["lines"])

    return write


def sync(left: DataFrame, right: DataFrame, tolerance: str = "50 milliseconds", late: str = "1 second") -> DataFrame:
    """Pairs of two streams (s, ts, id each) within the tolerance. Rows later than the watermark drop, as do the heads of lagging queues.

    Time is cut into spans of four tolerances. A right row lies in one, a left row goes to those that its tolerance meets, one or two, so that no row meets all that its key holds.
    """
    span = lambda at: F.expr(f"floor(unix_micros({at}) / greatest(4 * unix_micros(timestamp_seconds(0) + INTERVAL {tolerance}), 1))")
    l = left.withWatermark("ts", late).select(F.col("s").alias("l_s"), F.col("ts").alias("l_ts"), F.col("id").alias("l_id"))
    l = l.withColumn("l_span", F.explode(F.sequence(span(f"l_ts - INTERVAL {tolerance}"), span(f"l_ts + INTERVAL {tolerance}"))))
    r = right.withWatermark("ts", late).select(F.col("s").alias("r_s"), F.col("ts").alias("r_ts"), F.col("id").alias("r_id")).withColumn("r_span", span("r_ts"))
    near = F.expr(f"r_ts BETWEEN l_ts - INTERVAL {tolerance} AND l_ts + INTERVAL {tolerance}")
    return l.join(r, (F.col("l_s") == F.col("r_s")) & (F.col("l_span") == F.col("r_span")) & near).drop("l_span", "r_span")


def hopping(events: DataFrame, length: str = "500 milliseconds", step: str = "200 milliseconds", late: str = "1 second") -> DataFrame:
    """Counts and sums per key and hopping time window (s, ts, value); a stream or a batch."""
    on = events.withWatermark("ts", late) if events.isStreaming else events
    return on.groupBy("s", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("s", F.col("w.start").alias("start"), "n", "total")


class CountWindows(StatefulProcessor):
    """Windows of `length` frames with a stride, per key: emits a window once its last frame is there."""

    def __init__(self, length: int = 5, stride: int = 2):
        self.length, self.stride = length, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "window_id long, frames array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        window, frames = self.buffer.get() if self.buffer.exists() else (0, [])
        frames = list(frames) + sorted(int(f) for pdf in rows for f in pdf["frame_id"])
        out = []
        while len(frames) >= self.length:
            out += [(key[0], window, f, k) for k, f in enumerate(frames[: self.length])]
            frames, window = frames[self.stride :], window + 1
        self.buffer.update((window, frames))
        yield pd.DataFrame(out, columns=["session_id", "window_id", "frame_id", "no"])

    def close(self) -> None:
        pass


def count_windows(frames: DataFrame, length: int = 5, stride: int = 2) -> DataFrame:
    """The streaming form of windows over a session's frames (session_id int, frame_id), which arrive in order."""
    return frames.groupBy("session_id").transformWithStateInPandas(CountWindows(length, stride), "session_id int, window_id long, frame_id long, no int", "append", "None")


class LateRows(StatefulProcessor):
    """Marks the rows of a key that come over `allowed` ms after a later time has been seen, in order of arrival (event_id)."""

    def __init__(self, allowed: int):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "ts long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("event_id")
        before = self.latest.get()[0] if self.latest.exists() else -(1 << 62)
        top = np.maximum(np.maximum.accumulate(new["ts"].to_numpy()), before)
        self.latest.update((int(top[-1]),))
        yield pd.DataFrame({"s": key[0], "event_id": new["event_id"], "ts": new["ts"], "late": new["ts"].to_numpy() < top - self.allowed})

    def close(self) -> None:
        pass


def mark_late(rows: DataFrame, allowed: int) -> DataFrame:
    """A stream's rows (s long, event_id, ts in ms) with `late`: none is dropped, late ones can be sent aside and counted. A key's state is one number."""
    return rows.groupBy("s").transformWithStateInPandas(LateRows(allowed), "s long, event_id long, ts long, late boolean", "append", "None")


def aside_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes rows in time and late ones to folders of their own, by batch: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch={number}")

    return write


_TILE = ["session_id", "vx", "vy", "vz", "epoch", "n", "x", "y", "z", "ts"]


class TileMap(StatefulProcessor):
    """The voxels of one tile of a session. A voxel starts anew after `keep` seconds without a point, and with every new epoch.

    With timers (event time), a tile that hears nothing for `keep` seconds of the stream's watermark gives up its state, and says so by a row of n = 0 for each of its voxels.
    """

    def __init__(self, leaf: float = 1.0, keep: float = 20.0, timers: bool = False):
        self.leaf, self.keep, self.timers = leaf, keep, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a tile's voxels as one value, rows of (vx, vy, vz, epoch, n) and of (Σx, Σy, Σz, ts): a batch reads and writes it once
        self.tile = handle.getValueState("tile", "voxels binary, sums binary, swept double")

    def _held(self) -> tuple[np.ndarray, np.ndarray, float]:
        voxels, sums, swept = self.tile.get() if self.tile.exists() else (b"", b"", -np.inf)
        return np.frombuffer(voxels, np.int64).reshape(-1, 5), np.frombuffer(sums, np.float64).reshape(-1, 4), float(swept)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        cell = [(new[a] // self.leaf).astype("int64").to_numpy() for a in "xyz"]
        order = np.lexsort((new["ts"].to_numpy(), new["epoch"].to_numpy(), *cell[::-1]))
        cell, epoch, ts = [c[order] for c in cell], new["epoch"].to_numpy()[order].astype(np.int64), new["ts"].to_numpy()[order]
        first = np.r_[True, (np.diff(cell[0]) != 0) | (np.diff(cell[1]) != 0) | (np.diff(cell[2]) != 0)]
        of, start = np.cumsum(first) - 1, np.flatnonzero(first)
        last = np.r_[start[1:], len(of)] - 1
        # of a voxel's rows those of its last epoch count, from after their last gap
        late = epoch == epoch[last][of]
        inside = ~first & np.r_[False, late[:-1]]
        gap = inside & np.r_[False, np.diff(ts) > self.keep]
        begin = np.maximum.reduceat(np.where(late & (~inside | gap), np.arange(len(of)), 0), start)
        used = np.arange(len(of)) >= begin[of]
        sums = np.stack([np.add.reduceat(np.where(used, new[a].to_numpy()[order], 0.0), start) for a in "xyz"], axis=1)
        voxels = np.stack([*(c[start] for c in cell), epoch[last], last - begin + 1], axis=1)
        was, held, swept = self._held()
        place = {c: i for i, c in enumerate(zip(*was[:, :3].T.tolist()))}
        at = np.array([place.get(c, -1) for c in zip(*voxels[:, :3].T.tolist())])
        known = at >= 0
        if len(was):
            old, old_sums = was[at], held[at]
            ahead = known & (old[:, 3] > voxels[:, 3])  # late, of a map that a bad frame has ended
            goes_on = known & (old[:, 3] == voxels[:, 3]) & ~np.logical_or.reduceat(gap, start) & (ts[begin] - old_sums[:, 3] <= self.keep)
            voxels[goes_on, 4] += old[goes_on, 4]
            sums[goes_on] += old_sums[goes_on, :3]
            stamp = np.where(goes_on, np.maximum(ts[last], old_sums[:, 3]), ts[last])
            voxels, sums, stamp, at = voxels[~ahead], sums[~ahead], stamp[~ahead], at[~ahead]
        else:
            stamp = ts[last]
        rest = np.ones(len(was), bool)
        rest[at[at >= 0]] = False
        all_voxels, all_sums = np.concatenate([was[rest], voxels]), np.concatenate([held[rest], np.c_[sums, stamp]])
        top = float(ts.max())
        if swept < top - self.keep:
            fresh = all_sums[:, 3] >= top - self.keep
            all_voxels, all_sums, swept = all_voxels[fresh], all_sums[fresh], top
        self.tile.update((all_voxels.tobytes(), all_sums.tobytes(), swept))
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(1000 * (top + self.keep)) + 1)
        mean = sums / voxels[:, 4:]
        yield pd.DataFrame(dict(zip(_TILE, ([key[0]] * len(voxels), *voxels.T, *mean.T, stamp))))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        gone = [(key[0], *cell, 0, None, None, None, expiredTimerInfo.getExpiryTimeInMs() / 1000) for cell in self._held()[0][:, :4].tolist()]
        self.tile.clear()
        yield pd.DataFrame(gone, columns=_TILE).astype({"x": float, "y": float, "z": float})

    def close(self) -> None:
        pass


def tile_map(points: DataFrame, leaf: float = 1.0, keep: float = 20.0, tile: int = 8, late: str | None = None) -> DataFrame:
    """A session's local map by tiles of `tile` × `tile` voxels: each batch emits the voxels that it changed.

    points: session_id int, ts, x, y, z and epoch, the number of bad frames of the session so far: a bad frame ends the map in all tiles, whether or not
    they hear of it. Within a session batches come in order of time. A tile sweeps its old voxels at most once in `keep` seconds. Needs the RocksDB state store.
    With `late`, how long the watermark waits, tiles that hear nothing more lose their state by event-time timers.
    """
    out = "session_id int, vx long, vy long, vz long, epoch long, n long, x double, y double, z double, ts double"
    at = {f"tile_{a}": F.floor(F.floor(F.col(a) / leaf) / tile) for a in "xy"}
    on = points.select("session_id", "ts", "x", "y", "z", F.col("epoch").cast("long").alias("epoch")).withColumns(at)
    if late is None:
        return on.groupBy("session_id", "tile_x", "tile_y").transformWithStateInPandas(TileMap(leaf, keep), out, "update", "None")
    on = on.withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("at", late)
    return on.groupBy("session_id", "tile_x", "tile_y").transformWithStateInPandas(TileMap(leaf, keep, True), out, "update", "eventTime")


def current_map(changes: DataFrame, keep: float = 20.0) -> DataFrame:
    """The map as it stands after all changes of tile_map: each voxel's newest state, if of its session's last epoch and last `keep` seconds."""
    newest = changes.groupBy("session_id", "vx", "vy", "vz").agg(F.max(F.struct("epoch", "ts", "n", "x", "y", "z")).alias("v")).select("session_id", "vx", "vy", "vz", "v.*")
    last = changes.groupBy("session_id").agg(F.max("epoch").alias("last_epoch"), F.max("ts").alias("last_ts"))
    return newest.join(last, "session_id").where((F.col("epoch") == F.col("last_epoch")) & (F.col("ts") >= F.col("last_ts") - keep) & (F.col("n") > 0)).drop("last_epoch", "last_ts")


def status_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps Σ log-odds per point: each batch (pt_id, prob) writes its sums under its own number, so a repeated batch replaces itself; reading merges them."""

    def write(batch: DataFrame, number: int) -> None:
        logit = F.log(F.col("prob") / (1 - F.col("prob")))
        batch.groupBy("pt_id").agg(F.sum(logit).alias("s")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def compacting_sink(path: str, fan: int = 8) -> Callable[[DataFrame, int], None]:
    """As status_sink, with compaction: whenever fan, fan², … batches are complete, their sums become one folder, so that of n batches about fan · log n folders are left and a batch is rewritten log n times.

    A folder names the batches that it sums and counts once it is complete; readers take the widest of overlapping ones (`covering`). So nothing is lost or counted twice
    if a run ends between a merge and the deletes after it, or in either; a repeated batch or merge replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        logit = F.log(F.col("prob") / (1 - F.col("prob")))
        batch.groupBy("pt_id").agg(F.sum(logit).alias("s")).write.mode("overwrite").parquet(f"{path}/sums-{number}-{number}")
        width = fan
        while (number + 1) % width == 0:
            first = number + 1 - width
            parts = [x for x in covering(spark, path) if first <= x[0] and x[1] <= number]
            if parts != [(first, number)] and len(parts) > 1:
                spark.read.parquet(*(f"{path}/sums-{a}-{b}" for a, b in parts)).groupBy("pt_id").agg(F.sum("s").alias("s")).write.mode("overwrite").parquet(f"{path}/sums-{first}-{number}")
            for a, b in _folders(spark, path):
                if first <= a and b <= number and (a, b) != (first, number):
                    _delete(spark, f"{path}/sums-{a}-{b}")
            width *= fan

    return write


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First and last batch of each folder, complete or not."""
    fs, at = _file_system(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(tuple(map(int, x.split("-")[1:])) for x in names if x.startswith("sums-"))


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def covering(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The complete folders that no other complete one holds."""
    whole = [(a, b) for a, b in _folders(spark, path) if (x := _file_system(spark, f"{path}/sums-{a}-{b}/_SUCCESS"))[0].exists(x[1])]
    return [(a, b) for a, b in whole if not any((c, d) != (a, b) and c <= a and b <= d for c, d in whole)]


def compacted_status(spark: SparkSession, path: str) -> DataFrame:
    """pt_id, change_prob of all batches that compacting_sink has written."""
    sums = spark.read.schema("pt_id long, s double").parquet(*(f"{path}/sums-{a}-{b}" for a, b in covering(spark, path)))
    return sums.groupBy("pt_id").agg(F.sum("s").alias("s")).select("pt_id", (1 / (1 + F.exp(-F.col("s")))).alias("change_prob"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """pt_id, change_prob of all batches that status_sink has written."""
    return spark.read.parquet(path).groupBy("pt_id").agg(F.sum("s").alias("s")).select("pt_id", (1 / (1 + F.exp(-F.col("s")))).alias("change_prob"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """snapshot, pt_id, change_prob: the points that each batch of status_sink changed, as they stood after it. A snapshot in full is the newest row of each point up to it."""
    parts = spark.read.parquet(path).select(F.col("batch").cast("long").alias("snapshot"), "pt_id", "s")
    so_far = F.sum("s").over(Window.partitionBy("pt_id").orderBy("snapshot"))
    return parts.select("snapshot", "pt_id", (1 / (1 + F.exp(-so_far))).alias("change_prob"))
