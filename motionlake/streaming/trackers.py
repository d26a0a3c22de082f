"""Tracks that grow frame by frame: keyed state in a stream, and the same rows from a table.

Detections come in any order within the watermark's delay. A track keeps its last detection, how many it has had, and those that
the watermark hasn't passed yet; a timer hands these on in order of time once it has, each with its step from the detection
before. What waits is kept as columns, an element for each batch that brought rows, so that the calls to the state don't grow
with the rows. A track that isn't seen for ``gap`` ends: by the next detection that is passed on, or by a timer if none comes. What comes
out thus depends on the rows and the last watermark only, not on how the stream is cut into batches nor on restarts. Rows behind
the watermark are dropped by Spark. State is bounded by the tracks that are alive and the rows within the delay.

Output: keys, kind, ts, frame, x, y, vx, vy, n. Rows of kind ``seen`` are detections, n being their number in their track; rows of
kind ``ended`` have the track's last detection, and n all of its detections (fewer than three: a flicker). Steps are 0 at a track's
first row. Equal times are ordered by frame. Rows without a time or a key are ignored; null positions are kept and give null steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds without a detection after which a track ends.
GAP_MS = 6 * 3_600_000
#: Detections below which a track is a flicker.
FLICKER = 3

MEASURES = "ms long, frame long, x double, y double"
COLUMNS = "ms array<long>, frame array<long>, x array<double>, y array<double>"
OUT = "kind string, ms long, frame long, x double, y double, vx double, vy double, n long"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Tracker(StatefulProcessor):
    """State of one track: its last detection with its number, and detections that wait for the watermark."""

    def __init__(self, keys: list[str], fps: float, gap_ms: int):
        self.keys, self.fps, self.gap_ms = keys, fps, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{MEASURES}, n long")
        self.waiting = handle.getListState("waiting", COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [[], [], [], []]
        for part in rows:
            for column, name in zip(columns, ("ms", "frame"), strict=False):
                column += map(int, part[name].tolist())
            for column, name in zip(columns[2:], ("x", "y"), strict=True):
                column += [None if v is None or v != v else float(v) for v in part[name].tolist()]
        self.waiting.appendValue(tuple(columns))
        self.handle.registerTimer(min(columns[0]) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        order = lambda r: r[:2]
        rows = sorted((r for columns in self.waiting.get() for r in zip(*columns, strict=True)), key=order)
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        before = self.last.get()
        last = tuple(before) if before else None
        out = []
        for row in due:
            if last and row[0] - last[0] > self.gap_ms:
                out.append(ended(last))
                last = None
            out.append(seen(row, last, self.fps))
            last = (*row, out[-1][-1])
        if last and last[0] + self.gap_ms < now:
            out.append(ended(last))
            last = None
        if last:
            self.last.update(last)
            self.handle.registerTimer(last[0] + self.gap_ms + 1)
        elif before:
            self.last.clear()
        if later:
            self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
            self.handle.registerTimer(later[0][0] + 1)
        elif rows:
            self.waiting.clear()
        if out:
            yield self.frame_of(key, out)

    def frame_of(self, key, rows: list[tuple]) -> pd.DataFrame:
        columns = zip(*rows, strict=True)
        kinds = ["object", "int64", "int64", "float64", "float64", "float64", "float64", "int64"]
        names = [c.split()[0] for c in OUT.split(", ")]
        told = {n: np.array(c, dtype=k) for n, c, k in zip(names, columns, kinds, strict=True)}
        return pd.DataFrame({k: [v] * len(rows) for k, v in zip(self.keys, key, strict=True)} | told)

    def close(self) -> None:
        pass


def seen(row: tuple, last: tuple | None, fps: float) -> tuple:
    step = lambda a, b: None if a is None or b is None else (a - b) * fps
    v = (step(row[2], last[2]), step(row[3], last[3])) if last else (0.0, 0.0)
    return ("seen", *row, *v, last[4] + 1 if last else 1)


def ended(last: tuple) -> tuple:
    return ("ended", *last[:4], None, None, last[4])


def with_millis(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, ts, ms, frame, x and y of rows that have keys and a time."""
    rows = detections.dropna(subset=[*keys, "ts"])
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return rows.select(*keys, "ts", ms.alias("ms"), F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def told(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "kind", F.timestamp_millis("ms").alias("ts"), "frame", "x", "y", "vx", "vy", "n")


def track_stream(detections: DataFrame, keys: list[str], fps: float, delay: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Rows of the tracks of a stream of detections (keys, ts, frame, x, y), in append mode."""
    rows = with_millis(detections.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay), keys)
    out = ", ".join([*(f"`{k}` {detections.schema[k].dataType.simpleString()}" for k in keys), OUT])
    return told(rows.groupBy(*keys).transformWithStateInPandas(Tracker(keys, fps, gap_ms), out, "append", "EventTime"), keys)


def track_rows(detections: DataFrame, keys: list[str], fps: float, watermark: str | None = None, gap_ms: int = GAP_MS) -> DataFrame:
    """What the stream gives of a table once its watermark (a time; the table's latest if None) is reached."""
    rows = with_millis(detections, keys)
    now = F.unix_millis(F.lit(watermark).cast("timestamp")) if watermark else F.lit(rows.agg(F.max("ms")).first()[0])
    rows = rows.withColumn("now", now.cast("long"))
    w = Window.partitionBy(*keys).orderBy("ms", "frame")
    due = rows.where(F.col("ms") < F.col("now"))
    parted = due.withColumn("new", F.coalesce(F.col("ms") - F.lag("ms").over(w) > gap_ms, F.lit(True)))
    parted = parted.withColumn("part", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "part").orderBy("ms", "frame")
    v = lambda c: F.when(F.col("new"), 0.0).otherwise((F.col(c) - F.lag(c).over(w)) * fps)
    steps = parted.withColumns({"vx": v("x"), "vy": v("y"), "n": F.row_number().over(inner).cast("long"), "next": F.lead("ms").over(w)})
    seen_rows = F.struct(F.lit("seen").alias("kind"), "vx", "vy")
    over = F.coalesce(F.col("next") - F.col("ms") > gap_ms, F.col("ms") + gap_ms < F.col("now"))
    end = F.struct(F.lit("ended").alias("kind"), F.lit(None).cast("double").alias("vx"), F.lit(None).cast("double").alias("vy"))
    each = steps.withColumn("r", F.explode(F.when(over, F.array(seen_rows, end)).otherwise(F.array(seen_rows))))
    return told(each.select(*keys, "ms", "frame", "x", "y", "n", "r.*"), keys)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, in append mode into parquet files of the folder, and read them; called again, it goes on
    where it stopped. Keyed state lives in RocksDB, its checkpoints and the output in the folder, which executors have to share."""
    spark: SparkSession = stream.sparkSession
    name, value = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
