"""Motion channels of different rates on one grid, and the primitives that their changepoints part.

Samples are long rows (keys, channel, hold, t, v), so any number of channels goes through one window: each sample fills the grid
from its own time to the next one's, and nothing is joined to the grid. A clip's grid is bounded by its length; only the search for
changepoints gathers it, of one clip at a time.

A sample without a time or value is ignored. Before a channel's first sample and after its last it keeps their values if ``hold``,
else it is 0. A clip without samples has no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kinematics import nearest, quantiles
from .signals import kernel_changepoints, per_key

STEP_S = 0.1
#: The shortest clip and segment in seconds, samples below which a clip is one segment, how many are shown, and the
#: share of the high level and the least level of low motion.
LEAST_S, SEGMENT_S, LEAST_CELLS, SHOWN = 0.2, 0.5, 10, 24
LOW_SHARE, LOW_LEAST = 0.25, 0.5
#: Samples of a smoothing window; quadratics are fitted.
SMOOTH = 7


def speeds(rows: DataFrame, keys: list[str], t: str, at: list[str], least: int, track: str | None = None) -> DataFrame:
    """keys, t and v: distance from the sample before over the time since (1e-6 s at least), for tracks of ``least`` samples."""
    parts = [*keys, track] if track else keys
    w = Window.partitionBy(*parts).orderBy(t)
    squares = [(F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in at]
    moved = F.sqrt(sum(squares[1:], squares[0]))
    since = F.greatest(F.col(t) - F.lag(t).over(w), F.lit(1e-6))
    sized = rows.select(*keys, F.col(t).alias("t"), (moved / since).alias("v"), F.count("*").over(Window.partitionBy(*parts)).alias("n"))
    return sized.where((F.col("n") >= least) & F.col("v").isNotNull()).drop("n")


def per_second(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, t (the middle of each second that has samples) and v, their mean."""
    return rows.groupBy(*keys, F.floor(t).alias("second")).agg(F.avg(value).alias("v")).select(*keys, (F.col("second") + 0.5).alias("t"), "v")


def channel(rows: DataFrame, keys: list[str], name: str, hold: bool = False) -> DataFrame:
    return rows.select(*keys, F.lit(name).alias("channel"), F.lit(hold).alias("hold"), "t", "v")


def on_grid(samples: DataFrame, clips: DataFrame, keys: list[str], step: float = STEP_S) -> DataFrame:
    """keys, channel, i, t and v: every channel's value, linear between samples, at each step of its clip (keys, duration)."""
    rows = samples.dropna(subset=["t", "v"]).join(clips.select(*keys, "duration"), keys)
    cells = F.ceil(F.greatest(F.col("duration"), F.lit(LEAST_S)) / step)
    w = Window.partitionBy(*keys, "channel").orderBy("t", "v")
    rows = rows.withColumns({"cells": cells, "before": F.lag("t").over(w), "nt": F.lead("t").over(w), "nv": F.lead("v").over(w)})
    low = F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.floor(F.col("t") / step) - 1, F.lit(0)))
    high = F.when(F.col("nt").isNull(), F.col("cells") - 1).otherwise(F.least(F.ceil(F.col("nt") / step) + 1, F.col("cells") - 1))
    reach = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    x = F.col("i") * F.lit(step)
    wide = rows.withColumn("i", F.explode(reach)).withColumn("x", x)
    own = (F.col("before").isNull() | (F.col("x") >= F.col("t"))) & (F.col("nt").isNull() | (F.col("x") < F.col("nt")))
    outside = (F.col("x") < F.col("t")) | (F.col("nt").isNull() & (F.col("x") > F.col("t")))
    slope = F.try_divide(F.col("nv") - F.col("v"), F.col("nt") - F.col("t"))
    value = F.when(outside, F.when(F.col("hold"), F.col("v")).otherwise(0.0)).when(F.col("nt").isNull(), F.col("v")).otherwise(slope * (F.col("x") - F.col("t")) + F.col("v"))
    return wide.where(own).select(*keys, "channel", "i", F.col("x").alias("t"), value.alias("v"))


def activity(level: Column, high: Column) -> Column:
    """How a segment moves, from its subject's level and the clip's high one."""
    low = level > F.greatest(high * LOW_SHARE, F.lit(LOW_LEAST))
    return F.when((high > 0) & (level > high), "high_motion").when(low, "low_motion").otherwise("static")


def segment_levels(grid: DataFrame, keys: list[str], segment: str, subject: str) -> DataFrame:
    """keys, segment, activity, dominant (the channel highest above its mean in the clip, in deviations) and means by channel.

    A segment's cells are added up from the last one on, so that its mean has the same digits however the rows come in.
    """
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("i", "v"))))
    mean = F.aggregate(ordered, F.lit(0.0), lambda total, cell: total + cell["v"]) / F.count("v")
    clip = grid.groupBy(*keys, "channel").agg(F.avg("v").alias("clip_mean"), F.stddev_pop("v").alias("clip_dev"))
    part = grid.groupBy(*keys, segment, "channel").agg(mean.alias("mean")).join(clip, [*keys, "channel"])
    is_subject = F.col("channel") == subject
    above = (F.col("mean") - F.col("clip_mean")) / (F.col("clip_dev") + 1e-12)
    found = part.groupBy(*keys, segment).agg(
        F.coalesce(F.max(F.when(is_subject, F.col("mean"))), F.lit(0.0)).alias("level"),
        F.max(F.struct(F.round(above, 6).alias("above"), "channel")).alias("top"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round("mean", 4).alias("mean"))))).alias("means"),
    )
    high = quantiles(grid.where(is_subject), keys, "v", 0.75, "high").drop("n")
    return found.join(high, keys, "left").select(*keys, segment, activity(nearest("level", 4), F.coalesce("high", F.lit(0.0))).alias("activity"), F.col("top.channel").alias("dominant"), "level", "means")


def smoothed(x: np.ndarray) -> np.ndarray:
    """Columns smoothed by quadratics over SMOOTH samples; at the ends the first and the last quadratic hold."""
    at = np.vander(np.arange(SMOOTH) - SMOOTH // 2, 3).astype(float)
    fit = at @ np.linalg.pinv(at)
    half, out = SMOOTH // 2, x.copy()
    windows = np.lib.stride_tricks.sliding_window_view(x, SMOOTH, axis=0)
    out[half : len(x) - half] = windows @ fit[half]
    out[:half], out[len(x) - half :] = fit[:half] @ x[:SMOOTH], fit[-half:] @ x[-SMOOTH:]
    return out


def segment_ends(*series: np.ndarray) -> list[int]:
    """Ends of the segments of a clip's channels (nan: the clip lacks that channel)."""
    x = np.column_stack(series)
    x = x[:, [bool(np.isfinite(c).all()) and float(c.std()) > 1e-9 for c in x.T]]
    if x.shape[1] == 0 or len(x) < LEAST_CELLS:
        return [len(x)]
    x = smoothed(x)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-12)
    return kernel_changepoints(z, max(2, int(SEGMENT_S / STEP_S)), float(np.sqrt(x.shape[1]) * np.log(len(x))))


def primitives(grid: DataFrame, key: str, channels: list[str], subject: str, shown: int = SHOWN) -> DataFrame:
    """key, place, start_s, end_s, activity, dominant, level and means of a clip's first segments, of a grid of STEP_S."""
    wide = grid.groupBy(key, "i").agg(*[F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in channels])
    kind = grid.schema[key].dataType.simpleString()
    ends = per_key(wide, key, kind, "i", channels, lambda *series: {"ends": segment_ends(*series)}, "ends array<long>")
    placed = grid.join(ends, key).withColumn("place", F.size(F.filter("ends", lambda e: e <= F.col("i"))))
    bounds = ends.select(key, F.posexplode("ends").alias("place", "stop"), "ends")
    start = F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.get("ends", F.col("place") - 1))
    last = F.element_at("ends", -1) - 1
    second = lambda i: F.round(i * F.lit(STEP_S), 2)
    spans = bounds.select(key, "place", second(start).alias("start_s"), second(F.least(F.col("stop"), last)).alias("end_s")).where(F.col("place") < shown)
    return spans.join(segment_levels(placed, [key], "place", subject), [key, "place"])
