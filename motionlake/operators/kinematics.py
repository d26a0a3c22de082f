"""Motion of tracks: consecutive pairs, camera motion, velocities, ground line, runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import L_ANKLE, R_ANKLE, Thresholds

#: A track: persons and objects are numbered by different models, so their ids may clash.
TRACK = ["episode_id", "is_person", "track_id"]


def centers(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def with_next(tracks: DataFrame) -> DataFrame:
    """Tracks with centres and the next row of the same track: next_frame, next_cx, next_cy."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    return centers(tracks).withColumns({f"next_{c}": F.lead(c).over(w) for c in ("frame", "cx", "cy")})


def consecutive(tracks: DataFrame) -> DataFrame:
    """Only rows that are followed by the very next frame."""
    return with_next(tracks).where(F.col("next_frame") == F.col("frame") + 1)


def camera_motion(pairs: DataFrame, min_tracks: int = 3) -> DataFrame:
    """Median displacement for each start frame; with fewer tracks it can't be told from motion of their own."""
    return (
        pairs.groupBy("episode_id", "frame")
        .agg(F.median(F.col("next_cx") - F.col("cx")).alias("cam_x"), F.median(F.col("next_cy") - F.col("cy")).alias("cam_y"), F.count("*").alias("n_tracks"))
        .where(F.col("n_tracks") >= min_tracks)
    )


def with_diagonal(clips: DataFrame) -> DataFrame:
    return clips.withColumn("diag", F.hypot("width", "height"))


def velocities(tracks: DataFrame, clips: DataFrame) -> DataFrame:
    """Pairs with vx, vy and speed, the camera's motion taken off; a row stands at its start frame."""
    pairs = consecutive(tracks)
    moved = pairs.join(camera_motion(pairs).drop("n_tracks"), ["episode_id", "frame"], "left").join(with_diagonal(clips), "episode_id")
    cam_x, cam_y = (F.coalesce(c, F.lit(0.0)) for c in ("cam_x", "cam_y"))
    return moved.withColumns(
        {
            "cam_x": cam_x,
            "cam_y": cam_y,
            "vx": (F.col("next_cx") - F.col("cx") - cam_x) / F.col("diag") * F.col("fps"),
            "vy": (F.col("next_cy") - F.col("cy") - cam_y) / F.col("diag") * F.col("fps"),
        }
    ).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def distance(dx: Column, dy: Column) -> Column:
    """By the root of the squares' sum: hypot has other last digits, which part equal distances and move rows over a limit."""
    return F.sqrt(dx * dx + dy * dy)


def nearest(column: str, digits: int) -> Column:
    """To so many digits, halves of the scaled number away from zero, as SQL rounds; Spark's own goes by the number's shortest decimal form."""
    scale = F.lit(10.0**digits)
    return F.round(F.col(column) * scale) / scale


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: what the product loses, told from halves of its factors, is added with what the sum loses. For sizes below 1e140."""
    cut = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    ah, bh, p = cut(a), cut(b), a * b
    lost = (a - ah) * (b - bh) - (((p - ah * bh) - (a - ah) * bh) - ah * (b - bh))
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))
    return s + (rest + lost)


def quantiles(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """keys, the continuous quantile p of the value and n (rows): both neighbours by their shares, the lower one's product rounded with the sum, as in SQL."""
    w = Window.partitionBy(*keys)
    rank = (F.count(value).over(w) - 1) * F.lit(p)
    placed = rows.select(*keys, F.col(value).alias("__y"), (F.row_number().over(w.orderBy(F.asc_nulls_last(value))) - 1).alias("__k"), rank.alias("__rank"))
    at = lambda place: F.max(F.when(F.col("__k") == place, F.col("__y")))
    found = placed.groupBy(*keys).agg(
        at(F.floor("__rank")).alias("__lo"), at(F.ceil("__rank")).alias("__hi"), F.max(F.col("__rank") - F.floor("__rank")).alias("__d"), F.count("*").alias("n")
    )
    lo, hi, d = F.col("__lo").cast("double"), F.col("__hi").cast("double"), F.col("__d")
    plain = lo * (1 - d) + hi * d
    between = F.when(d == 0, lo).when(F.greatest(F.abs(lo), F.abs(hi)) < 1e140, fused(lo, 1 - d, hi * d)).otherwise(plain)
    return found.select(*keys, between.alias(name), "n")


def ground_line(kpts: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """ground_y of each clip from confident ankles; no row where there are too few."""
    ankles = kpts.where(F.col("kpt_idx").isin(L_ANKLE, R_ANKLE) & (F.col("conf") > 0.5))
    return quantiles(ankles, ["episode_id"], "y", th.ground_pct / 100, "ground_y").where(F.col("n") >= th.ground_min_points).drop("n")


def runs(rows: DataFrame, keys: list[str], order: str, flag: Column, min_len: int | Column, **aggregates: Column) -> DataFrame:
    """Runs of rows, in their order within the keys, for which flag holds: keys, first, last, n, frames and aggregates.

    Rows count by their place, not by the value of order: a row that was left out beforehand doesn't break a run.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("__on", F.coalesce(flag, F.lit(False))).withColumn("__place", F.row_number().over(w)).where("__on")
    island = F.col("__place") - F.row_number().over(w)
    found = numbered.withColumn("__island", island).groupBy(*keys, "__island").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_list(order)).alias("frames"), *[c.alias(k) for k, c in aggregates.items()]
    )
    return found.where(F.col("n") >= min_len).drop("__island")


def hysteresis(rows: DataFrame, keys: list[str], order: str, value: str, on: float, off: float, sustain: int) -> DataFrame:
    """rows with contact: on from the first of ``sustain`` rows in a run below ``on``, off from the first above ``off``.

    The state at a row is that of the last row at which it was decided; both events are known from windows alone.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    below = F.col(value) < on
    ahead = w.rowsBetween(0, sustain - 1)
    starts = (F.min(below.cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == sustain)
    event = F.when(F.col(value) > off, F.lit(False)).when(starts, F.lit(True))
    state = F.last("__event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__event", event).withColumn("contact", F.coalesce(state, F.lit(False))).drop("__event")


def edges(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Rising and falling edges; one stands at the first row if the flag holds there, one at the last likewise."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.coalesce(F.lag(flag).over(w), F.lit(False)), F.coalesce(F.lead(flag).over(w), F.lit(False))
    return rows.withColumns({"onset": F.col(flag) & ~before, "offset": F.col(flag) & ~after})
