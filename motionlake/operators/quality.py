"""Cross-checks of an episode, its feasibility, joint physics and judgements from frame statistics.

Every check works on long tables for all episodes at once; an episode that lacks a table has no value for its checks and
isn't failed by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .series import asof_nearest


@dataclass(frozen=True)
class QualityLimits:
    """Default limits of the cross-checks, of feasibility and of joint physics."""

    reproj_px: float = 15.0
    inside_ratio: float = 0.90
    depth_m: float = 0.15
    quat_norm: float = 1e-3
    jitter_m_s2: float = 80.0
    joint_vel_m_s: float = 8.0
    joint_acc_m_s2: float = 40.0
    violation_ratio: float = 0.25
    joint_vel_rad_s: float = 20.0
    joint_acc_rad_s2: float = 400.0


#: One matched frame in so many is compared with depth, at these joints.
DEPTH_STRIDE = 10
DEPTH_JOINTS = ["pelvis", "head"]


def array_of(reasons: list[Column]) -> Column:
    return F.array_compact(F.array(*reasons))


def above(name: str, limit: float) -> Column:
    return F.when(F.col(name) > limit, F.concat(F.lit(f"{name}="), F.round(name, 3).cast("string"), F.lit(f" exceeds {limit:g}")))


def below(name: str, limit: float) -> Column:
    return F.when(F.col(name) < limit, F.concat(F.lit(f"{name}="), F.round(name, 3).cast("string"), F.lit(f" below {limit:g}")))


def projected(body: DataFrame, poses: DataFrame, cameras: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Joints of valid frames in the image: keys, frame, joint, depth z, u, v, front, outside (pixels to the image).

    body: keys, t, joint, x, y, z, valid. poses: keys, t, frame, q (w, x, y, z), px, py, pz, valid. cameras: keys, fx, fy,
    cx, cy, width, height. Body and camera meet at the nearest time within the tolerance.
    """
    times = body.where("valid").select(*keys, "t").distinct()
    camera = F.struct("frame", "q", "px", "py", "pz", "valid").alias("pose")
    at = asof_nearest(times, poses.select(*keys, "t", camera), keys, "t", ["pose"], tolerance).where("pose.valid")
    rows = body.where("valid").join(at, [*keys, "t"]).join(cameras, keys)
    m = G.to_matrix(F.col("pose.q"))
    turn, shift = G.inverse(m, [F.col(f"pose.{c}") for c in ("px", "py", "pz")])
    x, y, z = G.transform(turn, shift, [F.col(c) for c in "xyz"])
    rows = rows.select(*keys, F.col("pose.frame").alias("frame"), "joint", x.alias("cam_x"), y.alias("cam_y"), z.alias("cam_z"), "fx", "fy", "cx", "cy", "width", "height")
    front = F.col("cam_z") > 1e-6
    depth = F.when(front, F.col("cam_z"))
    rows = rows.withColumns({"front": front, "u": F.col("fx") * F.col("cam_x") / depth + F.col("cx"), "v": F.col("fy") * F.col("cam_y") / depth + F.col("cy")})
    return rows.withColumn("outside", F.when(F.col("front"), G.outside_distance(F.col("u"), F.col("v"), F.col("width") - 1, F.col("height") - 1)))


def reprojection(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and 95th percentile of the pixels outside the image, shares of samples inside it and before the camera."""
    return points.groupBy(*keys).agg(
        F.avg("outside").alias("reproj_err_px_mean"),
        F.percentile("outside", F.lit(0.95)).alias("reproj_err_px_p95"),
        F.avg(F.coalesce(F.col("outside") == 0, F.lit(False)).cast("double")).alias("inside_frame_ratio"),
        F.avg(F.col("front").cast("double")).alias("front_ratio"),
    )


def depth_disagreement(points: DataFrame, depth: DataFrame, keys: list[str]) -> DataFrame:
    """Median difference to a depth table (keys, frame, u, v, depth) at every DEPTH_STRIDE-th frame; pixels without a measurement
    don't count."""
    order = F.dense_rank().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    some = points.withColumn("__i", order).where((F.col("__i") % DEPTH_STRIDE == 0) & F.col("joint").isin(DEPTH_JOINTS) & F.col("front"))
    pixel = some.select(*keys, "frame", F.bround("u").cast("long").alias("u"), F.bround("v").cast("long").alias("v"), "cam_z")
    found = pixel.join(depth, [*keys, "frame", "u", "v"]).where("depth > 0")
    return found.groupBy(*keys).agg(F.median(F.abs(F.col("depth") - F.col("cam_z"))).alias("depth_disagreement_m_median"))


def body_jitter(body: DataFrame, keys: list[str]) -> DataFrame:
    """Largest acceleration of a joint over three consecutive valid frames, by the median time step."""
    w = Window.partitionBy(*keys, "joint").orderBy("t")
    near = {f"{c}{k}": (F.lag(c) if k == 1 else F.lead(c)).over(w) for c in ("x", "y", "z", "valid") for k in (1, 2)}
    rows = body.withColumns({**near, "dt": F.col("t") - F.lag("t").over(w)})
    second = [F.col(f"{c}2") - 2 * F.col(c) + F.col(f"{c}1") for c in "xyz"]
    size = F.sqrt(second[0] * second[0] + second[1] * second[1] + second[2] * second[2])
    one = rows.groupBy(*keys).agg(F.max(F.when(F.col("valid") & F.col("valid1") & F.col("valid2"), size)).alias("top"), F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("dt"))
    return one.where("top IS NOT NULL AND dt > 0").select(*keys, (F.col("top") / (F.col("dt") * F.col("dt"))).alias("jitter_m_s2_max"))


def quaternion_error(tables: list[tuple[DataFrame, str]], keys: list[str]) -> DataFrame:
    """Largest deviation of a norm from 1 in the valid rows of all tables; each comes with its quaternion's name."""
    parts = None
    for rows, q in tables:
        kept = rows.where("valid") if "valid" in rows.columns else rows
        part = kept.select(*keys, F.abs(G.norm(F.col(q)) - 1).alias("off"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*keys).agg(F.max("off").alias("quat_norm_err_max"))


def in_time_order(rows: DataFrame, keys: list[str], within: list[str], order: str, t: str = "t") -> DataFrame:
    """keys and monotonic: whether t never falls in the given order within each group."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys, *within).orderBy(order))
    return rows.withColumn("__s", step).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("__s") >= 0), F.lit(True)).alias("monotonic"))


def crosschecks(episodes: DataFrame, checks: list[DataFrame], keys: list[str], synthetic: Column, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Each episode's metrics, how many checks ran, the reasons against it and whether it passes (vacuously without checks).

    checks: the tables of the functions above. Depth doesn't count where it was made up (synthetic).
    """
    rows = episodes
    for c in checks:
        rows = rows.join(c, keys, "left")
    behind = F.when(F.col("front_ratio") == 0, F.lit("reprojection: all joints behind camera"))
    reasons = array_of([
        behind, above("reproj_err_px_mean", limits.reproj_px), below("inside_frame_ratio", limits.inside_ratio),
        F.when(~synthetic, above("depth_disagreement_m_median", limits.depth_m)), above("jitter_m_s2_max", limits.jitter_m_s2), above("quat_norm_err_max", limits.quat_norm),
        F.when(~F.col("monotonic"), F.lit("timestamps not monotonic")),
    ])
    ran = [F.col("front_ratio"), F.col("depth_disagreement_m_median"), F.col("jitter_m_s2_max"), F.col("quat_norm_err_max"), F.col("monotonic").cast("int")]
    return rows.withColumns({"n_checks_run": F.size(F.array_compact(F.array(*[c.cast("double") for c in ran]))), "reasons": reasons}).withColumn("passed", F.size("reasons") == 0)


def feasibility_mask(body: DataFrame, keys: list[str], limits: QualityLimits = QualityLimits()) -> DataFrame:
    """keys, t, vel_spike, acc_spike, physics_violation and conf of each frame; both marks stand at the start of the motion.
    acc_spike is what others call a foot's slide: a change of speed, whatever moves.

    The acceleration is the change of all joints' speeds together over the later step.
    """
    w = Window.partitionBy(*keys, "joint").orderBy("t")
    step = [F.lead(c).over(w) - F.col(c) for c in "xyz"]
    rows = body.withColumns({"dt": F.lead("t").over(w) - F.col("t"), "d": F.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2])})
    rows = rows.withColumn("speed", F.when(F.col("dt") > 0, F.col("d") / F.col("dt")))
    rows = rows.withColumns({"change": F.lead("speed").over(w) - F.col("speed"), "dt2": F.lead("dt").over(w)})
    one = rows.groupBy(*keys, "t").agg(F.max("speed").alias("speed"), (F.sqrt(F.sum(F.col("change") * F.col("change"))) / F.max("dt2")).alias("acc"))
    bad = lambda c, limit: F.coalesce(F.col(c) > limit, F.lit(False))
    marked = one.select(*keys, "t", bad("speed", limits.joint_vel_m_s).alias("vel_spike"), bad("acc", limits.joint_acc_m_s2).alias("acc_spike")).withColumn("physics_violation", F.col("vel_spike") | F.col("acc_spike"))
    return marked.withColumn("conf", F.when(F.col("physics_violation"), 0.5).otherwise(1.0))


def feasibility_verdict(mask: DataFrame, keys: list[str], limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Share of frames in violation, what a rule recommends, its confidence, and whether the gate is passed."""
    most = limits.violation_ratio
    rows = mask.groupBy(*keys).agg(F.avg(F.col("physics_violation").cast("double")).alias("violation_ratio"), F.avg(F.col("vel_spike").cast("double")).alias("vel_spike_ratio"), F.avg(F.col("acc_spike").cast("double")).alias("acc_spike_ratio"))
    ratio = F.col("violation_ratio")
    advice = F.when(ratio <= most, "proceed").when(ratio > 1.5 * most, "reject").otherwise("human_review")
    rows = rows.withColumns({"plausible": ratio <= most, "tracking_valid": ratio < most, "artifact": ratio > 0.1, "confidence": F.greatest(F.lit(0.0), 1 - 3 * ratio), "recommendation": advice})
    return rows.withColumn("gate_passed", (F.col("recommendation") != "reject") & F.col("plausible"))


#: Checks that joints alone don't tell: two need a physics engine, ``robots.foot_slide`` needs contacts.
SKIPPED = ["self_collision", "ground_penetration", "foot_slide"]


def joint_physics(joints: DataFrame, keys: list[str], limits: QualityLimits = QualityLimits()) -> DataFrame:
    """keys, check, violations (frames), max_value, threshold and skipped; and for all checks valid and violation_ratio.

    joints: keys, frame, t, joint, q, lo, hi. A frame counts once for a check, whatever the number of joints; velocities and
    accelerations stand at the later frame, and time that doesn't rise never counts as motion.
    """
    w = Window.partitionBy(*keys, "joint").orderBy("frame")
    rows = joints.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("first", F.lag("q").over(w).isNull())
    speed = F.when(~F.col("first"), F.when(F.col("dt") > 0, F.abs(F.col("q") - F.lag("q").over(w)) / F.col("dt")).otherwise(0.0))
    rows = rows.withColumn("speed", speed).withColumn("before", F.lag("speed").over(w))
    rows = rows.withColumn("acc", F.when(F.col("before").isNotNull(), F.when(F.col("dt") > 0, F.abs(F.col("speed") - F.col("before")) / F.col("dt")).otherwise(0.0)))
    excess = F.greatest(F.col("lo") - F.col("q"), F.col("q") - F.col("hi"))
    frames = rows.groupBy(*keys, "frame").agg(F.max(excess).alias("joint_limits"), F.max("speed").alias("velocity_limits"), F.max("acc").alias("acceleration_limits"))
    names = {"joint_limits": 1e-9, "velocity_limits": limits.joint_vel_rad_s, "acceleration_limits": limits.joint_acc_rad_s2}
    bad = {n: F.coalesce(F.col(n) > t, F.lit(False)) for n, t in names.items()}
    one = frames.groupBy(*keys).agg(
        F.avg((bad["joint_limits"] | bad["velocity_limits"] | bad["acceleration_limits"]).cast("double")).alias("violation_ratio"),
        *[F.count_if(b).alias(f"{n}_bad") for n, b in bad.items()],
        *[F.coalesce(F.max(F.when(bad[n], F.col(n)) if n == "joint_limits" else F.col(n)), F.lit(0.0)).alias(f"{n}_top") for n in names],
    )
    told = [F.struct(F.lit(n).alias("check"), F.col(f"{n}_bad").alias("violations"), F.col(f"{n}_top").alias("max_value"), F.lit(0.0 if n == "joint_limits" else t).alias("threshold"), F.lit(False).alias("skipped")) for n, t in names.items()]
    told += [F.struct(F.lit(n).alias("check"), F.lit(0).cast("long").alias("violations"), F.lit(0.0).alias("max_value"), F.lit(0.0).alias("threshold"), F.lit(True).alias("skipped")) for n in SKIPPED]
    valid = F.lit(True)
    for n in names:
        valid = valid & (F.col(f"{n}_bad") == 0)
    return one.withColumn("physics_valid", valid).select(*keys, "physics_valid", "violation_ratio", F.explode(F.array(*told)).alias("c")).select(*keys, "physics_valid", "violation_ratio", "c.*")


# When frame statistics tell of content and motion, and when flow and size jump.
CONTENT_STD, LEAST_DIFF, MOST_DIFF = 5.0, 0.5, 60.0
SPIKE, SIZE_JUMP = 4.0, 1.5
MOST_SPIKES, MOST_JUMPS, LEAST_CONSISTENCY, LEAST_FRAMES, LEAST_POSE = 0.15, 0.20, 0.25, 10, 0.30


def frame_judge(frames: DataFrame, keys: list[str]) -> DataFrame:
    """What brightness (std) and the difference to the frame before (diff) of sampled frames say; no frames reject."""
    one = frames.groupBy(*keys).agg(F.count("std").alias("n"), F.min("std").alias("least_std"), F.max("diff").alias("top_diff"))
    content = (F.col("least_std") > CONTENT_STD) & F.coalesce(F.col("top_diff") < MOST_DIFF, F.lit(True))
    moving = F.coalesce(F.col("top_diff") > LEAST_DIFF, F.lit(False))
    none = F.col("n") == 0
    rows = one.withColumns({"plausible": ~none & F.coalesce(content, F.lit(False)), "tracking_valid": ~none & F.coalesce(content, F.lit(False)) & moving})
    advice = F.when(none, "reject").when(F.col("tracking_valid"), "proceed").otherwise("human_review")
    return rows.select(*keys, "plausible", "tracking_valid", advice.alias("recommendation"))


def motion_physics(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Spikes and steadiness of the flow, jumps of the moving area, and the reasons against a clip.

    frames: keys, frame, flow (null at the first), area, pose (whether one was found, may be null).
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    middle = frames.groupBy(*keys).agg(F.median("flow").alias("med"))
    rows = frames.withColumns({"step": F.abs(F.col("flow") - F.lag("flow").over(w)), "growth": (F.col("area") + 1e-4) / (F.lag("area").over(w) + 1e-4)}).join(middle, keys)
    med = F.col("med") + 1e-6
    one = rows.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.count("flow").alias("n_flow"), F.first("med").alias("med"),
        F.avg((F.col("flow") > SPIKE * med).cast("double")).alias("spikes"), F.avg("step").alias("step"),
        F.avg(((F.col("growth") > SIZE_JUMP) | (F.col("growth") < 1 / SIZE_JUMP)).cast("double")).alias("jumps"), F.avg(F.col("pose").cast("double")).alias("pose_rate"),
    )
    enough = F.col("n_flow") >= 3
    steady = F.least(F.greatest(1 - F.col("step") / ((F.col("med") + 1e-6) * 3), F.lit(0.0)), F.lit(1.0))
    rows = one.withColumns({
        "velocity_spike_ratio": F.when(enough, F.col("spikes")).otherwise(0.0), "flow_consistency": F.when(enough, steady).otherwise(1.0), "scale_jump_ratio": F.when(F.col("n_frames") >= 3, F.col("jumps")).otherwise(0.0),
    })
    reasons = array_of([
        F.when(F.col("n_frames") < LEAST_FRAMES, F.format_string("too few decodable frames (%d)", F.col("n_frames"))),
        F.when(F.col("velocity_spike_ratio") > MOST_SPIKES, F.lit("velocity_spike_ratio")), F.when(F.col("scale_jump_ratio") > MOST_JUMPS, F.lit("scale_jump_ratio")),
        F.when(F.col("flow_consistency") < LEAST_CONSISTENCY, F.lit("flow_consistency")), F.when(F.col("pose_rate") < LEAST_POSE, F.lit("pose_detection_rate")),
    ])
    return rows.select(*keys, "n_frames", "velocity_spike_ratio", "flow_consistency", "scale_jump_ratio", "pose_rate", reasons.alias("reasons"))


def depth_coverage(frames: DataFrame, keys: list[str], coverage: str) -> DataFrame:
    """Median coverage of every max(1, n // 10)-th frame."""
    w = Window.partitionBy(*keys)
    rows = frames.withColumns({"__i": F.row_number().over(w.orderBy("frame")) - 1, "__k": F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 10))})
    return rows.where(F.col("__i") % F.col("__k") == 0).groupBy(*keys).agg(F.median(coverage).alias("depth_coverage"))
