"""Queries of cross-checks, feasibility, joint physics and frame statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import adapters
from ..operators import kinematics as K
from ..operators import quality as Q
from .gate import TRACKS_SQL, rounded

EPISODE = ["episode_id"]
#: The views' bodies and joints are restless; half of a frame's time is the tolerance of a match.
LIMITS = Q.QualityLimits(joint_vel_m_s=12.0, joint_acc_m_s2=600.0, jitter_m_s2=900.0, quat_norm=2e-3, inside_ratio=0.98)
TOLERANCE_S = 0.5 / 30


def _points(spark, sf_dir):
    return Q.projected(adapters.body(spark, sf_dir), adapters.poses(spark, sf_dir), adapters.cameras(spark, sf_dir), EPISODE, TOLERANCE_S)


def _depth(points):
    """A depth table at the joints' own pixels, off by some centimetres."""
    off = F.when(F.col("frame") % 3 == 0, 0.2).otherwise(0.05)
    return points.where("front").select("episode_id", "frame", F.bround("u").cast("long").alias("u"), F.bround("v").cast("long").alias("v"), F.when(F.col("frame") % 20 == 10, 0.0).otherwise(F.col("cam_z") + off).alias("depth"))


def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.reprojection(_points(spark, sf_dir), EPISODE), 4, "reproj_err_px_mean", "reproj_err_px_p95", "inside_frame_ratio", "front_ratio")


def crosschecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, poses = _points(spark, sf_dir), adapters.poses(spark, sf_dir)
    late = adapters.joints(spark, sf_dir).withColumn("t", F.when((F.col("frame") == 30) & (F.col("episode_id") % 3 == 0), 0.0).otherwise(F.col("t")))
    parts = [
        Q.reprojection(points, EPISODE), Q.depth_disagreement(points, _depth(points), EPISODE), Q.body_jitter(adapters.body(spark, sf_dir), EPISODE),
        Q.quaternion_error([(poses, "raw"), (poses, "q")], EPISODE), Q.in_time_order(late, EPISODE, ["joint"], "frame"),
    ]
    found = Q.crosschecks(adapters.cameras(spark, sf_dir).select("episode_id"), parts, EPISODE, F.col("episode_id") % 4 == 0, LIMITS)
    metrics = ["depth_disagreement_m_median", "jitter_m_s2_max", "quat_norm_err_max"]
    return rounded(found.select("episode_id", *metrics, "monotonic", "n_checks_run", "passed", F.array_join("reasons", "; ").alias("reasons")), 3, *metrics)


def feasibility_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.feasibility_mask(adapters.body(spark, sf_dir), EPISODE, LIMITS), 6, "t")


def feasibility_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.feasibility_verdict(Q.feasibility_mask(adapters.body(spark, sf_dir), EPISODE, LIMITS), EPISODE, LIMITS)
    return rounded(found, 6, "violation_ratio", "vel_spike_ratio", "acc_spike_ratio", "confidence")


def joint_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.joint_physics(adapters.joints(spark, sf_dir), EPISODE), 4, "violation_ratio", "max_value")


def _frames(spark, sf_dir):
    """Tracks as clips: statistics of their frames."""
    w = Window.partitionBy(*K.TRACK).orderBy("frame")
    c = K.centers(adapters.tracks(spark, sf_dir))
    moved = F.abs(F.col("cx") - F.lag("cx").over(w))
    return c.select(*K.TRACK, "frame", ((F.col("x2") - F.col("x1")) / 4).alias("std"), moved.alias("diff"), moved.alias("flow"), ((F.col("y2") - F.col("y1")) / 600).alias("area"), (F.col("n_events") > 1).alias("pose"), (F.col("n_events") / 10).alias("coverage"))


def frame_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.frame_judge(_frames(spark, sf_dir), K.TRACK)


def motion_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.motion_physics(_frames(spark, sf_dir), K.TRACK).withColumn("reasons", F.array_join("reasons", "; "))
    return rounded(found, 5, "velocity_spike_ratio", "flow_consistency", "scale_jump_ratio", "pose_rate")


def depth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.depth_coverage(_frames(spark, sf_dir), K.TRACK, "coverage"), 6, "depth_coverage")


NAMES = [reprojection, crosschecks, feasibility_mask, feasibility_verdict, joint_physics, frame_judge, motion_physics, depth_coverage]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


N = adapters.EPISODE_FRAMES
BODY = f"""WITH em AS (SELECT vec_id // {N} AS episode_id, vec_id % {N} AS frame, (vec_id % {N}) / 30.0 AS t, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
body AS (SELECT episode_id, frame, t + 0.004 AS t, joint, e[b + 1] AS x, e[b + 2] AS y, 2 + e[b + 3] AS z, frame % 11 <> 5 AS valid FROM em CROSS JOIN (VALUES ('pelvis', 20), ('head', 23)) AS j(joint, b)),
raws AS (SELECT *, sqrt(1 + pow(e[28] / 4, 2) + pow(e[29] / 4, 2) + pow(e[30] / 4, 2)) AS n FROM em),
poses AS (SELECT episode_id, frame, t, 1 / n AS qw, e[28] / 4 / n AS qx, e[29] / 4 / n AS qy, e[30] / 4 / n AS qz, abs(1 + e[31] / 200) AS size, e[32] AS px, e[33] AS py, e[34] AS pz, frame % 13 <> 6 AS valid FROM raws)"""
POINTS = (
    BODY
    + """,
rel AS (SELECT b.episode_id, p.frame, joint, x - px AS dx, y - py AS dy, z - pz AS dz, qw, qx, qy, qz FROM body b JOIN poses p ON p.episode_id = b.episode_id AND p.frame = b.frame AND b.valid AND p.valid),
cam AS (SELECT episode_id, frame, joint, (1 - 2 * (qy * qy + qz * qz)) * dx + 2 * (qx * qy + qz * qw) * dy + 2 * (qx * qz - qy * qw) * dz AS cam_x,
  2 * (qx * qy - qz * qw) * dx + (1 - 2 * (qx * qx + qz * qz)) * dy + 2 * (qy * qz + qx * qw) * dz AS cam_y, 2 * (qx * qz + qy * qw) * dx + 2 * (qy * qz - qx * qw) * dy + (1 - 2 * (qx * qx + qy * qy)) * dz AS cam_z FROM rel),
uv AS (SELECT *, cam_z > 1e-6 AS front, CASE WHEN cam_z > 1e-6 THEN 1500 * cam_x / cam_z + 320 END AS u, CASE WHEN cam_z > 1e-6 THEN 1500 * cam_y / cam_z + 240 END AS v FROM cam),
pts AS (SELECT *, CASE WHEN front THEN sqrt(pow(greatest(-u, u - 639, 0), 2) + pow(greatest(-v, v - 479, 0), 2)) END AS outside FROM uv),
rep AS (SELECT episode_id, avg(outside) AS mean, quantile_cont(outside, 0.95) AS p95, avg(CAST(coalesce(outside = 0, false) AS INTEGER)) AS inside, avg(CAST(front AS INTEGER)) AS fr FROM pts GROUP BY 1)"""
)
BODY_STEPS = """,
st AS (SELECT *, lead(t) OVER w - t AS dt, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)) AS d FROM body WINDOW w AS (PARTITION BY episode_id, joint ORDER BY t)),
sp AS (SELECT *, d / dt AS speed FROM st), ch AS (SELECT *, lead(speed) OVER w - speed AS change, lead(dt) OVER w AS dt2 FROM sp WINDOW w AS (PARTITION BY episode_id, joint ORDER BY t)),
mk AS (SELECT episode_id, t, max(speed) AS speed, sqrt(sum(change * change)) / max(dt2) AS acc FROM ch GROUP BY ALL),
mask AS (SELECT episode_id, t, coalesce(speed > {v}, false) AS vel_spike, coalesce(acc > {a}, false) AS acc_spike FROM mk)""".format(v=LIMITS.joint_vel_m_s, a=LIMITS.joint_acc_m_s2)  # fmt: skip
FRAMES = (
    "WITH "
    + TRACKS_SQL
    + """fs AS (SELECT episode_id, is_person, track_id, frame, (x2 - x1) / 4 AS std, abs(cx - lag(cx) OVER w) AS flow, (y2 - y1) / 600 AS area, n_events > 1 AS pose, n_events / 10 AS coverage FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame))"""
)


def _told(name: str, column: str, sign: str, limit: float) -> str:
    return f"CASE WHEN {column} {'>' if sign == 'exceeds' else '<'} {limit} THEN '{name}=' || round({column}, 3) || ' {sign} {limit:g}' END"


def oracle_sql() -> dict[str, str]:
    lim, most = LIMITS, LIMITS.violation_ratio
    phys = Q.QualityLimits()
    return {
        "reprojection": POINTS + " SELECT episode_id, round(mean, 4) AS reproj_err_px_mean, round(p95, 4) AS reproj_err_px_p95, round(inside, 4) AS inside_frame_ratio, round(fr, 4) AS front_ratio FROM rep",
        "crosschecks": POINTS
        + f""",
        every AS (SELECT *, dense_rank() OVER (PARTITION BY episode_id ORDER BY frame) - 1 AS i FROM pts),
        dep AS (SELECT episode_id, frame, CAST(round_even(u, 0) AS BIGINT) AS u, CAST(round_even(v, 0) AS BIGINT) AS v, CASE WHEN frame % 20 = 10 THEN 0 ELSE cam_z + CASE WHEN frame % 3 = 0 THEN 0.2 ELSE 0.05 END END AS depth FROM pts WHERE front),
        dis AS (SELECT e.episode_id, median(abs(depth - cam_z)) AS d FROM every e JOIN dep ON dep.episode_id = e.episode_id AND dep.frame = e.frame AND dep.u = CAST(round_even(e.u, 0) AS BIGINT) AND dep.v = CAST(round_even(e.v, 0) AS BIGINT) WHERE front AND i % {Q.DEPTH_STRIDE} = 0 AND depth > 0 GROUP BY 1),
        tri AS (SELECT episode_id, t - lag(t) OVER w AS dt, CASE WHEN valid AND lag(valid) OVER w AND lead(valid) OVER w THEN sqrt(pow(lead(x) OVER w - 2 * x + lag(x) OVER w, 2) + pow(lead(y) OVER w - 2 * y + lag(y) OVER w, 2) + pow(lead(z) OVER w - 2 * z + lag(z) OVER w, 2)) END AS s FROM body WINDOW w AS (PARTITION BY episode_id, joint ORDER BY t)),
        jit AS (SELECT episode_id, max(s) / pow(median(dt) FILTER (dt > 0), 2) AS j FROM tri GROUP BY 1),
        qn AS (SELECT episode_id, max(greatest(abs(size - 1), abs(sqrt(qw * qw + qx * qx + qy * qy + qz * qz) - 1))) AS q FROM poses WHERE valid GROUP BY 1),
        a AS (SELECT r.*, d, j, q, NOT (r.episode_id % 3 = 0 AND r.episode_id * {N} + 30 <= (SELECT max(vec_id) FROM embeddings)) AS mono FROM rep r LEFT JOIN dis USING (episode_id) LEFT JOIN jit USING (episode_id) LEFT JOIN qn USING (episode_id)),
        w AS (SELECT *, concat_ws('; ', CASE WHEN fr = 0 THEN 'reprojection: all joints behind camera' END, {_told('reproj_err_px_mean', 'mean', 'exceeds', lim.reproj_px)}, {_told('inside_frame_ratio', 'inside', 'below', lim.inside_ratio)},
          CASE WHEN episode_id % 4 <> 0 THEN {_told('depth_disagreement_m_median', 'd', 'exceeds', lim.depth_m)} END, {_told('jitter_m_s2_max', 'j', 'exceeds', lim.jitter_m_s2)}, {_told('quat_norm_err_max', 'q', 'exceeds', lim.quat_norm)}, CASE WHEN NOT mono THEN 'timestamps not monotonic' END) AS reasons FROM a)
        SELECT episode_id, round(d, 3) AS depth_disagreement_m_median, round(j, 3) AS jitter_m_s2_max, round(q, 3) AS quat_norm_err_max, mono AS monotonic, 1 + CAST(fr IS NOT NULL AS INTEGER) + CAST(d IS NOT NULL AS INTEGER) + CAST(j IS NOT NULL AS INTEGER) + CAST(q IS NOT NULL AS INTEGER) AS n_checks_run, reasons = '' AS passed, reasons FROM w""",
        "feasibility_mask": BODY + BODY_STEPS + " SELECT episode_id, round(t, 6) AS t, vel_spike, acc_spike, vel_spike OR acc_spike AS physics_violation, CASE WHEN vel_spike OR acc_spike THEN 0.5 ELSE 1.0 END AS conf FROM mask",
        "feasibility_verdict": BODY + BODY_STEPS + f""", r AS (SELECT episode_id, avg(CAST(vel_spike OR acc_spike AS INTEGER)) AS v, avg(CAST(vel_spike AS INTEGER)) AS a, avg(CAST(acc_spike AS INTEGER)) AS b FROM mask GROUP BY 1),
        k AS (SELECT *, CASE WHEN v <= {most} THEN 'proceed' WHEN v > 1.5 * {most} THEN 'reject' ELSE 'human_review' END AS rec FROM r)
        SELECT episode_id, round(v, 6) AS violation_ratio, round(a, 6) AS vel_spike_ratio, round(b, 6) AS acc_spike_ratio, v <= {most} AS plausible, v < {most} AS tracking_valid, v > 0.1 AS artifact, round(greatest(0, 1 - 3 * v), 6) AS confidence, rec AS recommendation, rec <> 'reject' AND v <= {most} AS gate_passed FROM k""",
        "joint_physics": BODY.split("\nbody AS")[0].rstrip(",") + f""",
        js AS (SELECT episode_id, frame, t, j, 3 * e[35 + j] AS q FROM em CROSS JOIN (VALUES (0), (1), (2)) AS x(j)),
        s1 AS (SELECT *, t - lag(t) OVER w AS dt, abs(q - lag(q) OVER w) / (t - lag(t) OVER w) AS speed FROM js WINDOW w AS (PARTITION BY episode_id, j ORDER BY frame)),
        s2 AS (SELECT *, abs(speed - lag(speed) OVER w) / dt AS acc FROM s1 WINDOW w AS (PARTITION BY episode_id, j ORDER BY frame)),
        f AS (SELECT episode_id, frame, max(greatest(-0.9 - q, q - 0.9)) AS l, coalesce(max(speed), 0) AS v, coalesce(max(acc), 0) AS a FROM s2 GROUP BY ALL),
        g AS (SELECT episode_id, count(*) FILTER (l > 1e-9) AS nl, count(*) FILTER (v > {phys.joint_vel_rad_s}) AS nv, count(*) FILTER (a > {phys.joint_acc_rad_s2}) AS na, coalesce(max(l) FILTER (l > 1e-9), 0) AS ml, max(v) AS mv, max(a) AS ma, avg(CAST(l > 1e-9 OR v > {phys.joint_vel_rad_s} OR a > {phys.joint_acc_rad_s2} AS INTEGER)) AS r FROM f GROUP BY 1),
        c AS (SELECT episode_id, nl + nv + na = 0 AS ok, r, unnest([{{'c': 'joint_limits', 'n': nl, 'm': CAST(ml AS DOUBLE), 't': 0.0::DOUBLE, 's': false}}, {{'c': 'velocity_limits', 'n': nv, 'm': mv, 't': {phys.joint_vel_rad_s}::DOUBLE, 's': false}}, {{'c': 'acceleration_limits', 'n': na, 'm': ma, 't': {phys.joint_acc_rad_s2}::DOUBLE, 's': false}},
          {", ".join(f"{{'c': '{n}', 'n': 0, 'm': 0.0::DOUBLE, 't': 0.0::DOUBLE, 's': true}}" for n in Q.SKIPPED)}]) AS x FROM g)
        SELECT episode_id, ok AS physics_valid, round(r, 4) AS violation_ratio, x.c AS "check", x.n AS violations, round(x.m, 4) AS max_value, x.t AS threshold, x.s AS skipped FROM c""",
        "frame_judge": FRAMES + f""", g AS (SELECT episode_id, is_person, track_id, min(std) AS s, max(flow) AS d FROM fs GROUP BY ALL), p AS (SELECT *, s > {Q.CONTENT_STD} AND coalesce(d < {Q.MOST_DIFF}, true) AS ok, s > {Q.CONTENT_STD} AND coalesce(d < {Q.MOST_DIFF}, true) AND coalesce(d > {Q.LEAST_DIFF}, false) AS tv FROM g)
        SELECT episode_id, is_person, track_id, ok AS plausible, tv AS tracking_valid, CASE WHEN tv THEN 'proceed' ELSE 'human_review' END AS recommendation FROM p""",
        "motion_physics": FRAMES + f""", m AS (SELECT track_id, median(flow) AS med FROM fs GROUP BY 1), s AS (SELECT f.*, med, abs(flow - lag(flow) OVER w) AS step, (area + 0.0001) / (lag(area) OVER w + 0.0001) AS gr FROM fs f JOIN m USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
        g AS (SELECT episode_id, is_person, track_id, count(*) AS n, count(flow) AS nf, any_value(med) AS med, avg(CAST(flow > {Q.SPIKE} * (med + 1e-6) AS INTEGER)) AS sp, avg(step) AS st, avg(CAST(gr > {Q.SIZE_JUMP} OR gr < 1 / CAST({Q.SIZE_JUMP} AS DOUBLE) AS INTEGER)) AS j, avg(CAST(pose AS INTEGER)) AS p FROM s GROUP BY ALL),
        h AS (SELECT *, CASE WHEN nf >= 3 THEN sp ELSE 0 END AS v, CASE WHEN nf >= 3 THEN least(greatest(1 - st / ((med + 1e-6) * 3), 0), 1) ELSE 1 END AS c, CASE WHEN n >= 3 THEN j ELSE 0 END AS z FROM g)
        SELECT episode_id, is_person, track_id, n AS n_frames, round(v, 5) AS velocity_spike_ratio, round(c, 5) AS flow_consistency, round(z, 5) AS scale_jump_ratio, round(p, 5) AS pose_rate, concat_ws('; ', CASE WHEN n < {Q.LEAST_FRAMES} THEN 'too few decodable frames (' || n || ')' END, CASE WHEN v > {Q.MOST_SPIKES} THEN 'velocity_spike_ratio' END,
          CASE WHEN z > {Q.MOST_JUMPS} THEN 'scale_jump_ratio' END, CASE WHEN c < {Q.LEAST_CONSISTENCY} THEN 'flow_consistency' END, CASE WHEN p < {Q.LEAST_POSE} THEN 'pose_detection_rate' END) AS reasons FROM h""",
        "depth_coverage": FRAMES + """, i AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY track_id) // 10) AS k FROM fs)
        SELECT episode_id, is_person, track_id, round(median(coverage), 6) AS depth_coverage FROM i WHERE i % k = 0 GROUP BY ALL""",
    }
