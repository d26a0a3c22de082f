"""Hands and objects: contact inference, aperture, subtask segments, end effectors.

hands: keys, frame, t, hand, joint_name, px, py, pz, conf. objects: keys, frame, object_id, px, py, pz, conf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kinematics as K
from .series import interval_join, moving_average_zero

# Joints that may touch, the radius of an object without a mesh, distances that begin and end a contact.
FINGERTIPS = ["thumbTip", "indexFingerTip", "middleFingerTip", "ringFingerTip", "littleFingerTip", "wrist"]
OBJECT_RADIUS_M = 0.05
DIST_ON_M, DIST_OFF_M, SUSTAIN_FRAMES = 0.005, 0.010, 3

# Frames of a grasp or release, of a wait or lowering worth a segment, and metres of a reach and a lift.
GRASP_FRAMES, PAUSE_FRAMES, REACH_M, LIFT_M, MIN_LEN_S = 4, 6, 0.05, 0.04, 0.12
#: Frames of a block in joins of frames and windows.
BLOCK = 64


def distance(a: str, b: str) -> Column:
    """Between the points of two rows' structs."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in ("px", "py", "pz")]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def point(name: str) -> Column:
    return F.struct("px", "py", "pz").alias(name)


def infer_contacts(hands: DataFrame, objects: DataFrame, keys: list[str], on: float = DIST_ON_M, off: float = DIST_OFF_M, sustain: int = SUSTAIN_FRAMES) -> DataFrame:
    """A row for each hand, object and frame: contact with hysteresis, distance and penetration of the nearest fingertip.

    Both sides meet by frame, so the product of hands and objects stays within a frame. An object is a sphere, for which
    the distance is the same in its own frame and in the world's.
    """
    tips = hands.where(F.col("joint_name").isin(FINGERTIPS)).select(*keys, "frame", "t", "hand", point("tip"), F.col("conf").alias("tip_conf"))
    things = objects.select(*keys, "frame", "object_id", point("thing"), F.col("conf").alias("thing_conf"))
    near = tips.join(things, [*keys, "frame"]).groupBy(*keys, "frame", "hand", "object_id").agg(
        F.min("t").alias("t"), F.min(distance("tip", "thing") - OBJECT_RADIUS_M).alias("gap"), (F.avg("tip_conf") * F.first("thing_conf")).alias("sure")
    )
    zero = F.lit(0.0)
    found = K.hysteresis(near, [*keys, "hand", "object_id"], "frame", "gap", on, off, sustain)
    return found.select(
        *keys, "hand", "object_id", "frame", "t", "contact", F.greatest("gap", zero).alias("min_dist_m"), F.greatest(-F.col("gap"), zero).alias("penetration_m"),
        F.least(F.greatest("sure", zero), F.lit(1.0)).alias("conf"), F.lit(True).alias("valid"), F.lit("estimated").alias("source"),
    )


def touched(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hand, frame, contact (with any object) and object_id (the least one in contact)."""
    return contacts.groupBy(*keys, "hand", "frame").agg(F.bool_or("contact").alias("contact"), F.min(F.when(F.col("contact"), F.col("object_id"))).alias("object_id"))


def aperture(hands: DataFrame, keys: list[str]) -> DataFrame:
    """Thumb to index finger for each hand and frame; smoothed over five frames, zeros beyond the ends, where there are five."""
    at = lambda joint, name: F.max(F.when(F.col("joint_name") == joint, F.struct("px", "py", "pz"))).alias(name)
    rows = hands.groupBy(*keys, "hand", "frame").agg(F.min("t").alias("t"), at("thumbTip", "thumb"), at("indexFingerTip", "index")).where("thumb IS NOT NULL AND index IS NOT NULL")
    rows = rows.withColumn("raw", distance("thumb", "index"))
    one = [*keys, "hand"]
    smooth = F.when(F.count(F.lit(1)).over(Window.partitionBy(*one)) >= 5, moving_average_zero("raw", one, "frame", 5)).otherwise(F.col("raw"))
    return rows.select(*one, "frame", "t", smooth.alias("aperture_m"))


def hand_metrics(hands: DataFrame, keys: list[str], sure: float = 0.5) -> DataFrame:
    """Mean confidence, share of invalid samples, least and largest aperture of each hand."""
    base = hands.groupBy(*keys, "hand").agg(F.avg("conf").alias("mean_conf"), F.avg((F.col("conf") < sure).cast("double")).alias("invalid_ratio"))
    width = aperture(hands, keys).groupBy(*keys, "hand").agg(F.min("aperture_m").alias("min_aperture_m"), F.max("aperture_m").alias("max_aperture_m"))
    return base.join(width, [*keys, "hand"], "left")


def end_effectors(hands: DataFrame, keys: list[str]) -> DataFrame:
    """Wrist and aperture of each hand and frame."""
    wrist = hands.where(F.col("joint_name") == "wrist").select(*keys, "hand", "frame", "t", "px", "py", "pz", "conf")
    return wrist.join(aperture(hands, keys).drop("t"), [*keys, "hand", "frame"], "left")


def contact_windows(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, r, f, object_id, cursor and last: the contacts of a clip one by one.

    frames: keys, frame (from 0, without gaps), contact and object_id. r is the first frame of contact and f the first
    without (or the last frame); cursor is where the release of the contact before ends, and last the last frame.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = F.min(F.when(~F.col("contact"), F.col("frame"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = frames.withColumns({"f": off, "last": F.max("frame").over(whole), "before": F.coalesce(F.lag("contact").over(w), F.lit(False))})
    rises = rows.where("contact AND NOT before").select(*keys, F.col("frame").alias("r"), F.coalesce("f", "last").alias("f"), "object_id", "last")
    order = Window.partitionBy(*keys).orderBy("r")
    released = F.least(F.col("f") + GRASP_FRAMES, F.col("last"))
    return rises.withColumns({"k": F.row_number().over(order), "cursor": F.coalesce(F.lag(released).over(order), F.lit(0)), "released": released})


def pick(skill: str, verbs: list[str]) -> str:
    return skill if skill in verbs else "idle" if "idle" in verbs else verbs[0]


def subtask_segments(frames: DataFrame, heights: DataFrame, keys: list[str], verbs: list[str], min_len_s: float = MIN_LEN_S) -> DataFrame:
    """keys, place, start_s, end_s, skill and text: what a hand does, from its contacts.

    frames: keys, frame (from 0, without gaps), t, contact, object_id and reach (distance of the wrist to the nearest
    object, may be null). heights: keys, object_id, frame and z. Between two contacts the hand waits and reaches; in one
    it grasps, holds or lifts (and lowers) and releases. Where a contact begins and ends fixes the segments around it, and the
    release of the contact before is where the hand is free, so nothing has to be walked through in order.
    """
    windows = contact_windows(frames, keys)
    one = [*keys, "k"]
    approach = interval_join(frames.select(*keys, "frame", "reach").where("reach IS NOT NULL"), windows.select(*one, "cursor", (F.col("r") - 1).alias("to")), keys, "frame", "cursor", "to", BLOCK)
    approach = approach.groupBy(*one).agg(F.count("*").alias("n"), F.max("reach").alias("far"), F.min(F.struct(-F.col("reach"), F.col("frame").alias("at")))["at"].alias("far_at"), F.max_by("reach", "frame").alias("near"))
    rows = heights.where("z IS NOT NULL").withColumnRenamed("object_id", "thing")
    lifted = interval_join(rows, windows.select(*one, "object_id", "r", "f"), keys, "frame", "r", "f", BLOCK).where("thing = object_id")
    lifted = lifted.groupBy(*one).agg((F.max("z") - F.min_by("z", "frame")).alias("rise"), F.min(F.struct(-F.col("z"), F.col("frame").alias("at")))["at"].alias("top"))
    w = windows.join(approach, one, "left").join(lifted, one, "left")
    r, f, cursor, name = F.col("r"), F.col("f"), F.col("cursor"), F.coalesce(F.col("object_id").cast("string"), F.lit("object"))
    comes = (r > cursor + 2) & (F.col("n") >= 3) & (F.col("far") - F.col("near") > REACH_M)
    reach = F.when(F.coalesce(comes, F.lit(False)), F.col("far_at")).otherwise(cursor)
    lifts = F.coalesce(F.col("rise") > LIFT_M, F.lit(False))
    split = F.when(lifts & (F.col("top") - r < f - r + 1 - PAUSE_FRAMES), F.col("top"))
    held = F.least(r + GRASP_FRAMES, f)
    said = lambda verb, where, name=name: F.concat(F.lit(f"{where} "), name)
    part = lambda a, b, skill, text, when=F.lit(True): F.when(when & (b > a), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), (F.lit(pick(skill, verbs)) if isinstance(skill, str) else skill).alias("skill"), text.alias("text")))
    action = F.when(lifts, F.lit(pick("lift", verbs))).otherwise(F.lit(pick("hold", verbs)))
    doing = F.when(lifts, said("lift", "lift")).otherwise(said("hold", "hold"))
    parts = [
        part(cursor, reach, "idle", F.lit("waiting"), reach > cursor + PAUSE_FRAMES),
        part(reach, r, "reach", said("reach", "reach toward")),
        part(r, held, "grasp", said("grasp", "grasp")),
        part(held, F.coalesce(split, f), action, doing),
        part(split, f, "lower", said("lower", "lower"), split.isNotNull()),
        part(f, F.col("released"), "release", said("release", "release")),
    ]
    inner = w.select(*keys, "k", F.posexplode(F.array(*parts)).alias("i", "s")).where("s IS NOT NULL").select(*keys, "k", "i", "s.*")
    # After the last contact the hand is idle.
    clips = frames.groupBy(*keys).agg(F.max("frame").alias("last"))
    free = clips.join(windows.groupBy(*keys).agg(F.max("released").alias("released"), F.max("k").alias("k")), keys, "left")
    tail = free.where(F.coalesce("released", F.lit(0)) < F.col("last")).select(*keys, (F.coalesce("k", F.lit(0)) + 1).alias("k"), F.lit(0).alias("i"), F.coalesce("released", F.lit(0)).cast("long").alias("a"), F.col("last").cast("long").alias("b"), F.lit(pick("idle", verbs)).alias("skill"), F.lit("waiting").alias("text"))
    times = frames.select(*keys, F.col("frame").cast("long").alias("frame"), "t")
    timed = inner.unionByName(tail).join(times.withColumnRenamed("frame", "a").withColumnRenamed("t", "start_s"), [*keys, "a"]).join(times.withColumnRenamed("frame", "b").withColumnRenamed("t", "end_s"), [*keys, "b"])
    return merge_short(timed, keys, ["k", "i"], min_len_s)


def merge_short(segments: DataFrame, keys: list[str], order: list[str], min_len_s: float) -> DataFrame:
    """Segments shorter than min_len_s go to the one before them, but for the first; place numbers what is left from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    long = (F.col("end_s") - F.col("start_s") >= min_len_s) | (F.row_number().over(w) == 1)
    rows = segments.withColumn("__long", long.cast("int")).withColumn("place", F.sum("__long").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    first = F.struct(*order)
    return rows.groupBy(*keys, "place").agg(F.min("start_s").alias("start_s"), F.max_by("end_s", first).alias("end_s"), F.min_by("skill", first).alias("skill"), F.min_by("text", first).alias("text"))

