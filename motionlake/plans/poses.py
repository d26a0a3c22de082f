"""Queries of rotations, cameras, bodies and their resampling, and of texts around them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import geometry as G
from ..functions import text as X
from ..operators import kinematics as K
from ..operators import series as S
from .gate import TRACKS_SQL, rounded

GAP_S = 0.1


def rotation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation through its matrix, sixteen numbers and axis and angle, back to a quaternion each time."""
    rows = adapters.quaternions(spark, sf_dir).select("vec_id", G.normalized(F.col("q")).alias("q")).where("q.w IS NOT NULL")
    q = F.col("q")
    m = G.to_matrix(q)
    again, _ = G.unflatten(F.col("flat"))
    rows = rows.withColumn("flat", G.flatten(m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])).select("vec_id", "q", G.from_matrix(again).alias("a"), G.from_axis_angle(G.axis_angle(q)).alias("b"), F.get("flat", F.lit(7)).alias("ty"), G.is_rotation(again).alias("is_rotation"), G.is_rotation([-c for c in again]).alias("mirrored"), G.swapped(q)["w"].alias("last"))
    return rows.select("vec_id", *[F.round(f"{s}.{c}", 5).alias(f"{s}_{c}") for s in "ab" for c in "wxyz"], "ty", "is_rotation", "mirrored", F.round("last", 5).alias("last"))


def similar_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose under a similarity of scale 2."""
    rows = adapters.quaternions(spark, sf_dir).select("vec_id", G.normalized(F.col("q")).alias("q"), G.normalized(F.col("r")).alias("r"))
    turned, at = G.similar_pose(F.lit(2.0), G.to_matrix(F.col("q")), [F.lit(1.0), F.lit(0.0), F.lit(-1.0)], G.to_matrix(F.col("r")), [F.col("r.x"), F.col("r.y"), F.col("r.z")])
    return rows.select("vec_id", *[F.round(c, 5).alias(n) for c, n in zip(at, "xyz", strict=True)], F.round(turned[0] + turned[4] + turned[8], 5).alias("trace"))


def camera_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle pixels' points before the camera, and where a camera looks that looks at the origin."""
    rows = adapters.quaternions(spark, sf_dir)
    x, y, z = G.back_project(F.col("vec_id") % 64, F.col("vec_id") % 48, F.when(F.col("vec_id") % 5 != 0, 1.0 + F.abs("q.w")).otherwise(0.0), 50.0, 60.0, 32.0, 24.0)
    eye = [F.col(f"q.{c}") * 10 for c in "xyz"]
    m = G.look_at(eye, [F.lit(0.0)] * 3)
    return rows.select("vec_id", *[F.round(c, 5).alias(n) for c, n in zip((x, y, z), ("px", "py", "pz"), strict=True)], *[F.round(m[i], 5).alias(f"m{i}") for i in (0, 2, 5, 8)], F.round(G.focal_length(F.col("vec_id") % 150, 640.0), 3).alias("focal"))


def body_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knee angle, paw along the body and posture from points in the image."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(12)]
    rows = adapters.table(spark, sf_dir, "embeddings")
    x, y = G.in_body([e[0], e[1]], [e[2], e[3]], [e[4] + 1, e[5]], [e[6], e[7]], F.lit(2.0))
    ratio = F.when(F.col("vec_id") % 9 != 0, F.abs(e[10]) * 5)
    return rows.select("vec_id", F.round(G.joint_angle([e[0], e[1]], [e[2], e[3]]), 4).alias("knee"), F.round(x, 5).alias("along"), F.round(y, 5).alias("across"), G.posture(ratio).alias("posture"), F.round(G.fusion_confidence(F.abs(e[11])), 5).alias("confidence"))


def grasp_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau = (F.col("vec_id") % 50) / 50.0
    reach, grip, lift = G.grasp_phases(tau)
    return adapters.quaternions(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(n) for c, n in ((reach, "reach"), (grip, "grip"), (lift, "lift"))])


def _grid(spark, sf_dir):
    """Times between the frames of episodes; every fifth frame is missing from the samples, and one twice."""
    frames = adapters.poses(spark, sf_dir).select("episode_id", "frame", "t", "q", "px", "py", (F.col("frame") % 10 / 10).alias("conf"))
    return frames.select("episode_id", (F.col("t") + 0.5 / 30).alias("t")), frames.where("frame % 5 != 2 AND frame % 16 NOT IN (7, 8, 9, 10, 11)")


def resample_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, samples = _grid(spark, sf_dir)
    found = S.resample_quaternion(targets, samples, ["episode_id"], "t", "q", GAP_S)
    return found.select("episode_id", F.round("t", 4).alias("t"), *[F.round(f"q.{c}", 5).alias(c) for c in "wxyz"], "interpolated", "valid")


def resample_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, samples = _grid(spark, sf_dir)
    late = samples.where("frame = 20").withColumns({"px": F.col("px") + 1, "frame": F.lit(99).cast("long")})
    found = S.resample_poses(targets, samples.unionByName(late), ["episode_id"], "t", ["px", "py"], "conf", "frame")
    return rounded(found, 5, "px", "py", "conf").withColumn("t", F.round("t", 4))


def frame_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source frame of each frame at 7.5 a second."""
    users = adapters.series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    rows = S.canonical_timeline(users.withColumn("duration", F.least(F.col("n"), F.lit(40)) / 6.0), ["user_id"], "duration", 7.5).join(users, "user_id")
    return rows.select("user_id", "i", S.nearest_frame("t", 6.0, "n").alias("frame"))


def binned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a bin, by an aggregate of the caller's choice."""
    rows = adapters.series(spark, sf_dir).withColumn("day", F.col("t") / 86400.0)
    users = rows.select("user_id").distinct().withColumn("duration", F.lit(30.0))
    return S.fixed_bins(rows, ["user_id"], "day", F.col("v"), 1.0, users, agg=F.count)


def annotated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a frame as annotations, frames without any left out."""
    r = lambda c: F.round(1.0007 * c, 1)
    box = F.struct("label", "track_id", r(F.col("x1")).alias("x"), r(F.col("y1")).alias("y"), r(F.col("x2") - F.col("x1")).alias("w"), r(F.col("y2") - F.col("y1")).alias("h"))
    rows = adapters.tracks(spark, sf_dir).groupBy("episode_id", "frame").agg(F.array_sort(F.collect_list(box)).alias("a"))
    text = F.transform("a", lambda b: F.concat_ws(":", b["label"], b["track_id"], b["x"], b["y"], b["w"], b["h"]))
    return rows.select("episode_id", "frame", F.size("a").alias("n"), F.array_join(text, ",").alias("annotations"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(F.col("p_partkey") / 8)
    spec = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" cam"), "p_partkey", F.lit(" : /a:"), "p_name"))
    prompt = X.variant_prompt(F.concat("p_name", F.lit(" .. ")), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.lit("From above.")), F.lit("soft light"), F.lit("dusk"))
    rows = part.select("p_partkey", X.rate_text(value).alias("rate"), X.cam_spec(spec).alias("c"), X.job_id(F.col("p_name"), F.lit("2024-01-01")).alias("job"), prompt.alias("prompt"))
    return rows.select("p_partkey", "rate", F.col("c.cam_id").alias("cam_id"), F.col("c.path").alias("path"), "job", "prompt")


NAMES = [rotation_forms, similar_poses, camera_rays, body_frames, grasp_cycle, resample_slerp, resample_poses, frame_mapping, binned_counts, annotated_frames, text_forms]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


Q = """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS a, sqrt(e[5] * e[5] + e[6] * e[6] + e[7] * e[7] + e[8] * e[8]) AS b FROM e),
q AS (SELECT vec_id, e, e[1] / a AS w, e[2] / a AS x, e[3] / a AS y, e[4] / a AS z, e[5] / b AS rw, e[6] / b AS rx, e[7] / b AS ry, e[8] / b AS rz FROM n)"""
N = adapters.EPISODE_FRAMES
GRID = f"""WITH em AS (SELECT vec_id // {N} AS episode_id, vec_id % {N} AS frame, (vec_id % {N}) / 30.0 AS t, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
po AS (SELECT episode_id, frame, t, sqrt(1 + pow(e[28] / 4, 2) + pow(e[29] / 4, 2) + pow(e[30] / 4, 2)) AS n, e, e[32] AS px, e[33] AS py, (frame % 10) / 10.0 AS conf FROM em),
sa AS (SELECT episode_id, frame, t, [1 / n, e[28] / 4 / n, e[29] / 4 / n, e[30] / 4 / n] AS q, px + CASE WHEN frame = 20 THEN 1 ELSE 0 END AS px, py, conf FROM po WHERE frame % 5 <> 2 AND frame % 16 NOT IN (7, 8, 9, 10, 11)),
ta AS (SELECT episode_id, t + 0.5 / 30 AS t FROM em),
br AS (SELECT ta.episode_id, ta.t, (SELECT max(s.t) FROM sa s WHERE s.episode_id = ta.episode_id AND s.t <= ta.t) AS tb, (SELECT min(s.t) FROM sa s WHERE s.episode_id = ta.episode_id AND s.t > ta.t) AS ta FROM ta),
jo AS (SELECT br.*, (br.t - tb) / (br.ta - tb) AS k, b.q AS qb, a.q AS qa, b.px AS pb, a.px AS pa, b.py AS yb, a.py AS ya, b.conf AS cb, a.conf AS ca FROM br LEFT JOIN sa b ON b.episode_id = br.episode_id AND b.t = tb LEFT JOIN sa a ON a.episode_id = br.episode_id AND a.t = br.ta)"""


def oracle_sql() -> dict[str, str]:
    sign = "CASE WHEN w < 0 THEN -1 ELSE 1 END"
    jerk = lambda x: f"(pow({x}, 3) * (10 - 15 * ({x}) + 6 * pow({x}, 2)))"
    axis = "sqrt(pow(e[5] + 1 - e[7], 2) + pow(e[6] - e[8], 2))"
    gap = GAP_S + 1e-6
    return {
        "rotation_forms": Q + " SELECT vec_id, " + ", ".join(f"round({sign} * {c}, 5) + 0 AS {s}_{c}" for s in "ab" for c in "wxyz") + ", 2.0 AS ty, true AS is_rotation, false AS mirrored, round(w, 5) AS last FROM q",
        "similar_poses": Q + """ SELECT vec_id, round(2 * ((1 - 2 * (y * y + z * z)) * rx + 2 * (x * y - z * w) * ry + 2 * (x * z + y * w) * rz) + 1, 5) AS x, round(2 * (2 * (x * y + z * w) * rx + (1 - 2 * (x * x + z * z)) * ry + 2 * (y * z - x * w) * rz), 5) AS y,
            round(2 * (2 * (x * z - y * w) * rx + 2 * (y * z + x * w) * ry + (1 - 2 * (x * x + y * y)) * rz) - 1, 5) AS z, round(4 * pow(w * rw - x * rx - y * ry - z * rz, 2) - 1, 5) AS trace FROM q""",
        "camera_rays": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 1 + abs(CAST(embedding[1] AS DOUBLE)) END AS d, 10 * CAST(embedding[2] AS DOUBLE) AS x, 10 * CAST(embedding[3] AS DOUBLE) AS y, 10 * CAST(embedding[4] AS DOUBLE) AS z FROM embeddings),
            f AS (SELECT *, sqrt(x * x + y * y + z * z) + 1e-8 AS n FROM e), g AS (SELECT *, -x / n AS fx, -y / n AS fy, -z / n AS fz FROM f), h AS (SELECT *, sqrt(fy * fy + fx * fx) + 1e-8 AS k FROM g)
            SELECT vec_id, round((vec_id % 64 + 0.5 - 32) * d / 50, 5) AS px, round((vec_id % 48 + 0.5 - 24) * d / 60, 5) AS py, round(d, 5) AS pz, round(fy / k, 5) AS m0, round(fx, 5) AS m2, round(fy, 5) AS m5, round(fz, 5) AS m8, round(640 / (2 * tan(radians(least(greatest(vec_id % 150, 20), 120)) / 2)), 3) AS focal FROM h""",
        "body_frames": "WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), "
        + f"""f AS (SELECT *, (e[5] + 1 - e[7]) / {axis} AS ux, (e[6] - e[8]) / {axis} AS uy, e[1] - e[3] AS dx, e[2] - e[4] AS dy FROM e)
            SELECT vec_id, round(acos(least(greatest(-(e[1] * e[3] + e[2] * e[4]) / (sqrt(e[1] * e[1] + e[2] * e[2]) * sqrt(e[3] * e[3] + e[4] * e[4]) + 1e-9), -1), 1)), 4) AS knee, round((dx * ux + dy * uy) / 2, 5) AS along, round((dy * ux - dx * uy) / 2, 5) AS across,
              CASE WHEN vec_id % 9 = 0 THEN 'unknown' WHEN abs(e[11]) * 5 > 0.55 THEN 'standing_or_walking' ELSE 'recumbent_or_low' END AS posture, round(exp(-abs(e[12]) / 0.05), 5) AS confidence FROM f""",
        "grasp_cycle": f"""WITH t AS (SELECT vec_id, (vec_id % 50) / 50.0 AS t FROM embeddings) SELECT vec_id, round(CASE WHEN t < 0.3 THEN {jerk('t / 0.3')} WHEN t < 0.8 THEN 1 ELSE 1 - {jerk('(t - 0.8) / 0.2')} END, 6) AS reach,
            round(CASE WHEN t < 0.3 THEN 0 WHEN t < 0.4 THEN {jerk('(t - 0.3) / 0.1')} WHEN t < 0.7 THEN 1 WHEN t < 0.8 THEN 1 - {jerk('(t - 0.7) / 0.1')} ELSE 0 END, 6) AS grip, round(CASE WHEN t >= 0.4 AND t < 0.55 THEN {jerk('(t - 0.4) / 0.15')} WHEN t >= 0.55 AND t < 0.7 THEN 1 - {jerk('(t - 0.55) / 0.15')} ELSE 0 END, 6) AS lift FROM t""",
        "resample_slerp": GRID
        + f""", d AS (SELECT *, least(abs(list_dot_product(qb, qa)), 1) AS d, CASE WHEN list_dot_product(qb, qa) < 0 THEN -1 ELSE 1 END AS s, coalesce(ta - tb <= {gap}, false) AS ok FROM jo),
            th AS (SELECT *, acos(d) AS th FROM d), m AS (SELECT *, CASE WHEN NOT ok THEN coalesce(qb, qa) ELSE [(sin((1 - k) * th) * qb[i] + s * sin(k * th) * qa[i]) / sin(th) FOR i IN range(1, 5)] END AS v FROM th),
            z AS (SELECT *, CASE WHEN ok THEN sqrt(list_dot_product(v, v)) ELSE 1 END AS n FROM m)
            SELECT episode_id, round(t, 4) AS t, round(v[1] / n, 5) AS w, round(v[2] / n, 5) AS x, round(v[3] / n, 5) AS y, round(v[4] / n, 5) AS z, ok AS interpolated, ok AS valid FROM z""",
        "resample_poses": GRID
        + f""", o AS (SELECT *, coalesce(ta - tb <= {S.MAX_GAP_S + 1e-6}, false) AS ok FROM jo), m AS (SELECT episode_id, t, ok, CASE WHEN ok THEN (1 - k) * pb + k * pa ELSE coalesce(pb, pa) END AS px, CASE WHEN ok THEN (1 - k) * yb + k * ya ELSE coalesce(yb, ya) END AS py, CASE WHEN ok THEN (1 - k) * cb + k * ca ELSE coalesce(cb, ca) END AS conf FROM o)
            SELECT episode_id, round(t, 4) AS t, round(px, 5) AS px, round(py, 5) AS py, round(conf, 5) AS conf, ok AND round(conf, 9) >= 0.5 AS valid FROM m""",
        "frame_mapping": "WITH u AS (SELECT user_id, count(DISTINCT (event_type, ts)) AS n FROM events GROUP BY 1) SELECT user_id, i, CAST(least(round_even(i / CAST(7.5 AS DOUBLE) * 6, 0), n - 1) AS BIGINT) AS frame FROM u, range(60) r(i) WHERE i <= floor(least(n, 40) / 6 * 7.5 + 1e-9)",
        "binned_counts": "WITH s AS (SELECT DISTINCT user_id, event_type, ts FROM events), u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, CAST(floor((epoch_us(ts) / 1e6 - 1704067200.0) / 86400) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL) SELECT u.user_id, b AS bin, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM u CROSS JOIN range(30) r(b) LEFT JOIN c ON c.user_id = u.user_id AND c.bin = b",
        "annotated_frames": "WITH " + TRACKS_SQL.rstrip().rstrip(",") + " SELECT episode_id, frame, CAST(count(*) AS INTEGER) AS n, string_agg(concat_ws(':', label, track_id, round(1.0007 * x1, 1), round(1.0007 * y1, 1), round(1.0007 * (x2 - x1), 1), round(1.0007 * (y2 - y1), 1)), ',' ORDER BY label, track_id) AS annotations FROM tracks GROUP BY 1, 2",
        "text_forms": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '0' WHEN p_partkey / 8 >= 10 THEN format('{:,}', CAST(floor(p_partkey / 8 + 0.5) AS BIGINT)) ELSE printf('%.1f', round_even(p_partkey / 8, 1)) END AS rate, CASE WHEN p_partkey % 5 <> 0 THEN 'cam' || p_partkey END AS cam_id, CASE WHEN p_partkey % 5 <> 0 THEN '/a:' || p_name END AS path,
            coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 24), ''), 'job') || '_' || left(sha256(p_name || ':2024-01-01'), 6) AS job,
            regexp_replace(p_name, '[. ]+$', '') || CASE WHEN p_partkey % 3 <> 0 THEN '. From above' ELSE '' END || '. soft light, dusk. Static camera, single continuous shot.' AS prompt FROM part""",
    }
