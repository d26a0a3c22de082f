"""Motion of detections and of travelling bodies: gradients, headings, object summaries, banners, presence, status folds."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import moving_average_edge

# Seconds a hit may be listed for and what makes it strong; a track's least rows, its movement, how many are shown.
STRONG, SECONDS_SHOWN = 0.2, 30
TRACK_ROWS, MOVING, TRACKS_SHOWN = 3, 0.05, 12
#: Yaw is held to this many radians a second, and trusted fully from this many body lengths a second on.
MOST_YAW, SURE_SPEED = 1.5, 0.3


def gradient(value: str, keys: list[str], order: str) -> Column:
    """Central differences a row, one-sided at the ends; null for a single row."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - own).otherwise(own - before)


def unwrapped(angle: str, keys: list[str], order: str) -> Column:
    """Angles without jumps of more than half a turn: each step is taken the short way round, and steps are summed up."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(angle) - F.lag(angle).over(w)
    short = step - 2 * math.pi * F.round(step / (2 * math.pi))
    return F.struct(F.first(angle).over(w).alias("start"), F.coalesce(short, F.lit(0.0)).alias("step"))


def travel(rows: DataFrame, keys: list[str], order: str, x: str, y: str, fps: float, length: Column) -> DataFrame:
    """speed (lengths a second) and yaw_rate (radians a second) of a body's path, from smoothed positions.

    A heading means little while the body hardly moves, so the yaw is weighted by the speed.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    smooth = lambda c, win: F.when(n >= win, moving_average_edge(c, keys, order, win)).otherwise(F.col(c))
    out = rows.withColumns({"__x": smooth(x, 7), "__y": smooth(y, 7)})
    out = out.withColumns({"__vx": gradient("__x", keys, order) * fps, "__vy": gradient("__y", keys, order) * fps})
    out = out.withColumns({"__v": F.hypot("__vx", "__vy") / length, "__h": F.atan2("__vy", "__vx")})
    out = out.withColumns({"speed": smooth("__v", 5), "__u": unwrapped("__h", keys, order)})
    out = out.withColumn("__head", F.col("__u.start") + F.sum("__u.step").over(w)).withColumn("__turn", gradient("__head", keys, order) * fps)
    held = F.least(F.greatest(smooth("__turn", 7), F.lit(-MOST_YAW)), F.lit(MOST_YAW))
    trust = F.least(F.greatest(F.col("speed") / SURE_SPEED, F.lit(0.0)), F.lit(1.0))
    short = n <= 4  # too few samples for a path
    out = out.withColumns({"path_conf": F.when(short, 0.0).otherwise(trust), "yaw_rate": F.when(short, 0.0).otherwise(held * trust), "speed": F.when(short, 0.0).otherwise(F.col("speed"))})
    return out.drop("__x", "__y", "__vx", "__vy", "__v", "__h", "__u", "__head", "__turn")


def detection_velocity(rows: DataFrame, keys: list[str], order: str, x: str, y: str, fps: float) -> DataFrame:
    """vx and vy from the detection before, however long ago; 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = lambda c: F.coalesce((F.col(c) - F.lag(c).over(w)) * fps, F.lit(0.0))
    return rows.withColumns({"vx": v(x), "vy": v(y)})


def continuous(rows: DataFrame, keys: list[str], order: str, q: str) -> DataFrame:
    """Quaternions (struct w, x, y, z) with signs flipped so that neighbours never point apart.

    A row's sign is the product of the signs of all dots before it; a dot of zero starts anew with its own sign.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    dot = reduce(Column.__add__, [F.col(f"{q}.{c}") * F.lag(f"{q}.{c}").over(w) for c in "wxyz"])
    rows = rows.withColumn("__d", dot)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__part", F.coalesce(F.sum((F.col("__d") == 0).cast("int")).over(so_far), F.lit(0)))
    inner = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    odd = F.sum(F.coalesce((F.col("__d") < 0).cast("int"), F.lit(0))).over(inner) % 2
    sign = F.when(odd == 1, -1.0).otherwise(1.0)
    return rows.withColumn("__s", sign).withColumn(q, F.struct(*[(F.col(f"{q}.{c}") * F.col("__s")).alias(c) for c in "wxyz"])).drop("__d", "__part", "__s")


def object_tracks(rows: DataFrame, keys: list[str], t: str, paths: DataFrame, area: Column, name: str) -> DataFrame:
    """First and last time, most frequent class, growth (last three areas to first three) and movement of tracks of
    TRACK_ROWS rows; paths: keys and length. place orders a clip's tracks by their length."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(t)
    ranked = rows.withColumns({"__a": F.row_number().over(order), "__n": F.count(F.lit(1)).over(w), "__area": area}).where(F.col("__n") >= TRACK_ROWS)
    ratio = F.avg(F.when(F.col("__a") > F.col("__n") - 3, F.col("__area"))) / F.greatest(F.avg(F.when(F.col("__a") <= 3, F.col("__area"))), F.lit(1e-9))
    one = ranked.groupBy(*keys).agg(F.min(t).alias("t_first"), F.max(t).alias("t_last"), F.mode(name, True).alias(name), ratio.alias("size_change_ratio"))
    found = one.join(paths, keys, "left").withColumn("length", F.coalesce("length", F.lit(0.0))).withColumn("moving", F.col("length") > MOVING)
    return found.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.desc("length"), *keys[1:])))


def hit_summary(queries: DataFrame, hits: DataFrame, key: str, query: str, t: str, conf: str) -> DataFrame:
    """For each query: its hits, the best of them, the seconds with strong ones and a verdict; queries without hits stay."""
    strong = F.col(conf) >= STRONG
    one = hits.groupBy(key, query).agg(F.count("*").alias("n_hits"), F.max(conf).alias("max_conf"), F.array_sort(F.collect_set(F.when(strong, F.floor(t).cast("long")))).alias("s"))
    rows = queries.join(one, [key, query], "left")
    verdict = F.when(F.size("s") > 0, "present").when(F.col("n_hits") > 0, "weak_evidence").otherwise("not_found")
    none = F.array().cast("array<bigint>")
    return rows.select(key, query, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce(F.round("max_conf", 3), F.lit(0.0)).alias("max_conf"), F.coalesce(F.slice("s", 1, SECONDS_SHOWN), none).alias("present_seconds"), verdict.alias("verdict"))


def banner(violations: DataFrame, keys: list[str], frames: str, kind: str, hold: int) -> DataFrame:
    """keys, frame and types: what is shown over a frame, each type for hold frames after the one that it was found in."""
    each = violations.select(*keys, kind, F.explode(frames).alias("__f")).select(*keys, kind, F.explode(F.sequence(F.col("__f"), F.col("__f") + hold)).alias("frame"))
    return each.groupBy(*keys, "frame").agg(F.array_sort(F.collect_set(kind)).alias("types"))


def energy(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 400) -> DataFrame:
    """Mean square of each whole window of width samples; it stands at the window's first sample."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    out = rows.withColumns({"energy": F.sum(F.col(value) * F.col(value)).over(ahead) / width, "__n": F.count(F.lit(1)).over(ahead)})
    return out.where(F.col("__n") == width).select(*keys, order, "energy")


# The pipeline's stages as they are shown, and the ends of a batch.
CIRCUIT = ["queue", "intent", "contract", "scenarios", "prompts", "render", "verify", "export"]
TERMINAL = ["completed", "partial", "failed"]


def circuit_stage(agent: Column, message: Column) -> Column:
    """The stage that a log entry speaks of; null if of none."""
    m, a = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(agent, F.lit("")))
    has = lambda *words: reduce(Column.__or__, [F.contains(m, F.lit(w)) for w in words])
    # Words and agents of each stage, in the order in which they count.
    return (
        F.when((m == "") & (a == ""), None)
        .when(has("batch") & has("finished"), "export")
        .when(has("pipeline complete"), "prompts")
        .when(has("starting") & has("video job"), "render")
        .when((has("starting agent pipeline") & has("intent")) | has("batch ", "uploaded "), "queue")
        .when(a.isin("omni", "veo") | has("gemini omni", "video output", "saved "), "render")
        .when((a == "verifier") | has("verifier", "annotation", "extracted tracks", "labeled preview", "label"), "verify")
        .when(a.isin("compiler", "canvas") | has("compiling prompts", "keyframes", "canvas", "start frame", "visual anchors", "anchor"), "prompts")
        .when(a.isin("scenarios", "validator") | has("planning ", "scenario", "repair", "dropping", "violate"), "scenarios")
        .when((a == "contract") | has("contract"), "contract")
        .when((a == "intent") | has("intent"), "intent")
    )


def circuit_status(logs: DataFrame, batches: DataFrame, key: str, order: str) -> DataFrame:
    """key, stage and status (done, warning, failed, running or queued) of each batch's stages.

    logs: key, order, level, agent, message. batches: key and status. Of a stage the last warning or error counts; the last
    error fails its stage. What is before the furthest stage seen is done.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in CIRCUIT]), F.col("stage")) - 1
    seen = logs.withColumn("stage", circuit_stage(F.col("agent"), F.col("message"))).where("stage IS NOT NULL").withColumn("place", place)
    loud = F.when(F.col("level").isin("warn", "error"), F.col(order))
    marks = seen.groupBy(key, "stage").agg(F.max_by("level", loud).alias("mark"))
    warned = marks.where("mark = 'warn'").groupBy(key).agg(F.collect_set("stage").alias("warned"))
    folded = seen.groupBy(key).agg(F.max("place").alias("latest"), F.max_by("place", F.when(F.col("level") == "error", F.col(order))).alias("failed"))
    rows = batches.join(folded, key, "left").join(warned, key, "left")
    ends = F.col("status").isin(TERMINAL)
    latest = F.greatest(F.coalesce("latest", F.lit(0)), F.when(ends, F.lit(len(CIRCUIT) - 1)).otherwise(0))
    failed = F.coalesce("failed", F.when(F.col("status") == "failed", latest))
    some = F.coalesce("warned", F.array().cast("array<string>"))
    some = F.when(F.col("status") == "partial", F.array_union(some, F.array(F.lit("export")))).otherwise(some)
    active = F.when(ends & failed.isNull(), F.lit(len(CIRCUIT) - 1)).otherwise(latest)
    rows = rows.withColumns({"failed": failed, "active": active, "warned": some}).select(key, "status", "failed", "active", "warned", F.posexplode(F.array(*[F.lit(s) for s in CIRCUIT])).alias("i", "stage"))
    i, warns = F.col("i"), F.array_contains("warned", F.col("stage"))
    told = (
        F.when(F.col("failed").isNotNull(), F.when(i < F.col("failed"), "done").when(i == F.col("failed"), "failed").otherwise("queued"))
        .when(F.col("status") == "completed", "done")
        .when(i <= F.col("active"), F.when(warns, "warning").when((i < F.col("active")) | F.col("status").isin(TERMINAL), "done").otherwise("running"))
        .otherwise("queued")
    )
    return rows.select(key, "stage", told.alias("state"))


def phase_history(updates: DataFrame, key: str, order: str, phase: str, fields: list[str]) -> DataFrame:
    """The present phase of each job, all its phases in order, and of each field the last value that was given."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    past = F.transform(F.array_sort(F.collect_list(F.struct(order, phase))), lambda x: x[phase])
    return updates.groupBy(key).agg(F.max_by(phase, order).alias(phase), past.alias("history"), *last)
