"""Gaits of four-legged animals from keypoints: paws in the body's own frame, leg angles, strides and targets of feet.

keypoints: keys, frame, t, name, u, v, conf. Most is windows and aggregates by clip and leg; only spectra and lags of a clip's paw
signals go through a Python function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import signals
from .motion import travel
from .series import moving_average_edge

# Keypoints of each leg from the body outwards, and those before and behind the body's middle.
LEGS = {
    "FL": ("front_left_thai", "front_left_knee", "front_left_paw"),
    "FR": ("front_right_thai", "front_right_knee", "front_right_paw"),
    "RL": ("back_left_thai", "back_left_knee", "back_left_paw"),
    "RR": ("back_right_thai", "back_right_knee", "back_right_paw"),
}
FORE, HIND = ("back_base", "neck_base"), ("tail_base", "back_end")
SMOOTH = 5


def body_frames(keypoints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, t, points (name -> u, v, conf), fore, hind and hips (points), body, the clip's median length, framed and up.

    Fore and hind are the first of their keypoints that are seen in over half of the clip's frames. A clip that lacks either, or all
    thighs, isn't framed: its axes are the picture's, with up upwards (-1), and lengths are its own.
    """
    point = F.struct("u", "v", "conf")
    rows = keypoints.groupBy(*keys, "frame").agg(F.min("t").alias("t"), F.map_from_entries(F.collect_list(F.struct("name", point.alias("p")))).alias("points"))
    w = Window.partitionBy(*keys)
    at = lambda name: F.try_element_at("points", F.lit(name))
    seen = lambda name: F.avg(at(name)["u"].isNotNull().cast("double")).over(w) > 0.5
    anchor = lambda names: F.when(seen(names[0]), at(names[0])).when(seen(names[1]), at(names[1]))
    thighs = F.array_compact(F.array(*[at(leg[0]) for leg in LEGS.values()]))
    mean = lambda c: F.when(F.size(thighs) > 0, F.aggregate(thighs, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(thighs))
    framed = (seen(FORE[0]) | seen(FORE[1])) & (seen(HIND[0]) | seen(HIND[1])) & F.max(F.size(thighs) > 0).over(w)
    rows = rows.withColumns({"framed": framed, "fore": anchor(FORE), "hind": anchor(HIND), "hips": F.struct(mean("u").alias("u"), mean("v").alias("v"))})
    own = lambda c, u: F.when(F.col("framed"), F.struct(F.col(f"{c}.u").alias("u"), F.col(f"{c}.v").alias("v"))).otherwise(F.struct(F.lit(u).alias("u"), F.lit(0.0).alias("v")))
    rows = rows.withColumns({"fore": own("fore", 1.0), "hind": own("hind", 0.0), "hips": own("hips", 0.0), "up": F.when(F.col("framed"), 1.0).otherwise(-1.0)})
    long = F.hypot(F.col("fore.u") - F.col("hind.u"), F.col("fore.v") - F.col("hind.v"))
    return rows.withColumn("__l", F.when(long >= 1e-6, long)).withColumn("body", F.median("__l").over(w)).drop("__l")


def leg_series(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, leg, frame, t, the smoothed paw (x along, y across the body, in body lengths), thigh and knee angles and conf."""
    named = F.explode(F.array(*[F.struct(F.lit(leg).alias("leg"), *[F.try_element_at("points", F.lit(n)).alias(k) for n, k in zip(names, ("thigh", "knee", "paw"), strict=True)]) for leg, names in LEGS.items()]))
    rows = frames.withColumn("l", named).where("l.thigh IS NOT NULL AND l.knee IS NOT NULL AND l.paw IS NOT NULL")
    xy = lambda p: [F.col(f"{p}.u"), F.col(f"{p}.v")]
    x, y = G.in_body(xy("l.paw"), xy("hips"), xy("fore"), xy("hind"), F.col("body"))
    thigh = [F.col("l.knee.u") - F.col("l.thigh.u"), F.col("l.knee.v") - F.col("l.thigh.v")]
    shank = [F.col("l.paw.u") - F.col("l.knee.u"), F.col("l.paw.v") - F.col("l.knee.v")]
    rows = rows.select(*keys, "l.leg", "frame", "t", x.alias("x"), (y * F.col("up")).alias("y"), F.atan2(thigh[1], thigh[0]).alias("thigh_angle"), G.joint_angle(thigh, shank).alias("knee_angle"), F.least("l.thigh.conf", "l.knee.conf", "l.paw.conf").alias("conf"))
    one = [*keys, "leg"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*one))
    smooth = lambda c: F.when(n >= SMOOTH, moving_average_edge(c, one, "frame", SMOOTH)).otherwise(F.col(c)).alias(c)
    return rows.select(*one, "frame", "t", *[smooth(c) for c in ("x", "y", "thigh_angle", "knee_angle")], "conf")


def leg_summary(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Each leg's amplitude, share of time on the ground, mean confidence, and whether it is the clip's reference (the largest
    amplitude)."""
    middle = F.median("y").over(Window.partitionBy(*keys, "leg"))
    one = legs.withColumn("swings", F.col("y") > middle).groupBy(*keys, "leg").agg(F.stddev_pop("y").alias("amplitude"), (1 - F.avg(F.col("swings").cast("double"))).alias("duty"), F.avg("conf").alias("conf"))
    return one.withColumn("reference", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("amplitude"), "leg")) == 1)


def strides(legs: DataFrame, key: str, kind: str, fps: float) -> DataFrame:
    """key, period of the reference leg's stride and the phase of each leg in it (0 to 1)."""
    names = list(LEGS)
    wide = legs.groupBy(key, "frame").pivot("leg", names).agg(F.first("y"))

    def work(*series: np.ndarray) -> dict:
        there = [i for i, s in enumerate(series) if np.isfinite(s).any()]
        ref = max(there, key=lambda i: float(np.nanstd(series[i])), default=None)
        period = signals.dominant_period(series[ref], fps) if ref is not None else 0.0
        filled = [np.where(np.isfinite(s), s - np.nanmean(s), 0.0) if i in there else None for i, s in enumerate(series)]
        lag = lambda s: signals.phase_lag(filled[ref], s) * len(s) / (period * fps) % 1.0
        return {"period": period, **{n: None if s is None else lag(s) if period > 0 and np.ptp(s) > 1e-12 else 0.0 for n, s in zip(names, filled, strict=True)}}

    return signals.per_key(wide, key, kind, "frame", names, work, "period double, " + ", ".join(f"{n} double" for n in names))


def gait_summary(keypoints: DataFrame, key: str, kind: str, fps: float) -> DataFrame:
    """Period, median speed (body lengths a second), gait and phases of each clip."""
    frames = body_frames(keypoints, [key])
    legs = leg_series(frames, [key])
    path = travel(frames.select(key, "frame", F.col("hips.u").alias("u"), F.col("hips.v").alias("v"), "body"), [key], "frame", "u", "v", fps, F.col("body"))
    speed = path.groupBy(key).agg(F.coalesce(F.median("speed"), F.lit(0.0)).alias("speed"))
    rows = speed.join(strides(legs, key, kind, fps), key, "left")
    return rows.withColumn("gait", signals.gait_class("period", "speed", F.col("period").isNotNull()))


def foot_targets(legs: DataFrame, keys: list[str], hips: Column, stance: float, fore_gain: float, lift_gain: float, scale: float) -> DataFrame:
    """keys, leg, frame, x, y, z of a robot's feet: the paw's way along the body about its mean, and its lift above its median,
    which never goes below the stance. hips: a struct (x, y, z) of each leg's hip."""
    w = Window.partitionBy(*keys, "leg")
    fore, lift = F.col("x") - F.avg("x").over(w), F.col("y") - F.median("y").over(w)
    rows = legs.withColumns({"__h": hips, "__f": F.coalesce(fore, F.lit(0.0)) * fore_gain * scale, "__l": F.greatest(F.coalesce(lift, F.lit(0.0)) * lift_gain * scale, F.lit(0.0))})
    return rows.select(*keys, "leg", "frame", (F.col("__h.x") + F.col("__f")).alias("x"), F.col("__h.y").alias("y"), (F.col("__h.z") - stance + F.col("__l")).alias("z"))
