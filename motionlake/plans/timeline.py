"""Queries of time series, intervals and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import geometry as G
from ..operators import kinematics as K
from ..operators import series as S
from .gate import TRACKS_SQL, rounded

USER = ["user_id", "event_type"]
GRID_S = 43200.0
GAP_S = 86400.0


def _durations(spark, sf_dir):
    return adapters.intervals(spark, sf_dir).groupBy("conv_id").agg(F.max("end_s").alias("duration"))


def canonical_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.canonical_timeline(_durations(spark, sf_dir), ["conv_id"], "duration", 0.5), 6, "t")


def _clicks(spark, sf_dir):
    return adapters.series(spark, sf_dir).where("event_type = 'click'").drop("event_type")


def _targets(clicks):
    return clicks.groupBy("user_id").agg(F.max("t").alias("last")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / GRID_S) + 1)).alias("i")).select("user_id", (F.col("i") * GRID_S).alias("t"))


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _clicks(spark, sf_dir)
    return rounded(S.resample_linear(_targets(clicks), clicks, ["user_id"], "t", "v", GAP_S), 6, "v")


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _clicks(spark, sf_dir)
    return rounded(S.asof_nearest(_targets(clicks), clicks, ["user_id"], "t", ["v"], GAP_S / 4), 6, "v", "matched_t")


def densify_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.densify(K.centers(adapters.tracks(spark, sf_dir)), K.TRACK, "frame", ["cx", "cy"], 3)
    return rounded(found, 5, "cx", "cy")


def moving_average_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.centers(adapters.tracks(spark, sf_dir))
    return c.select(*K.TRACK, "frame", F.round(S.moving_average_edge("cx", K.TRACK, "frame", 5), 5).alias("cx"))


def moving_average_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.centers(adapters.tracks(spark, sf_dir))
    return c.select(*K.TRACK, "frame", F.round(S.moving_average_zero("cx", K.TRACK, "frame", 5), 5).alias("cx"))


def _daily(spark, sf_dir):
    rows = adapters.series(spark, sf_dir)
    users = rows.select("user_id").distinct().withColumn("duration", F.lit(30.0))
    return S.fixed_bins(rows.withColumn("day", F.col("t") / 86400.0), ["user_id"], "day", F.col("v"), 1.0, users)


def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_daily(spark, sf_dir), 6, "v")


def motion_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.changepoints(_daily(spark, sf_dir), ["user_id"], "bin", "v"), 4, "step").select("user_id", "bin", "step")


def _contact(spark, sf_dir):
    return K.hysteresis(adapters.contacts(spark, sf_dir), ["object_id"], "frame", "distance", 0.012, 0.02, 2)


def hysteresis_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contact(spark, sf_dir).select("object_id", "frame", "contact")


def contact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.edges(_contact(spark, sf_dir), ["object_id"], "frame", "contact")
    return rows.groupBy("object_id").agg(F.count_if("onset").alias("onsets"), F.count_if("offset").alias("offsets"), F.count_if("contact").alias("rows_on"))


def path_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.path_descriptors(K.centers(adapters.tracks(spark, sf_dir)), K.TRACK, "frame", "cx", "cy")
    return rounded(found, 4, "length", "net", "straightness")


def velocity_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.velocity_limits(_clicks(spark, sf_dir), ["user_id"], "t", "v", 0.005, 1e-6)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("vel_spike").alias("vel_spikes"), F.count_if("acc_spike").alias("acc_spikes"))


def jitter_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.jitter(K.centers(adapters.tracks(spark, sf_dir)), K.TRACK, "frame", "cx"), 4, "jitter")


def duty_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.duty_factor(adapters.series(spark, sf_dir), ["event_type"], "v"), 6, "duty")


def presence_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.flicker(_daily(spark, sf_dir), ["user_id"], "bin", F.col("v") / 50), 6, "flicker")


def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    return S.keep_last(events, ["user_id"], [F.desc("event_id")], 5).select("user_id", "place", "event_id", "event_type")


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    return S.every_nth(events, ["user_id"], "event_id", 10).select("user_id", "event_id")


def evenly_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    return S.evenly(events, ["user_id"], "event_id", 6).select("user_id", "event_id")


def frame_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decimate(adapters.tracks(spark, sf_dir), K.TRACK, "frame", 2.5).select(*K.TRACK, "frame")


def _points(spark, sf_dir):
    return _durations(spark, sf_dir).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") / 3))).alias("i")).select("conv_id", (F.col("i") * 3.0).alias("t"))


def _assigned(spark, sf_dir, how):
    points = _points(spark, sf_dir)
    turns = adapters.intervals(spark, sf_dir).where("end_s > start_s")
    held = S.interval_join(points, turns, ["conv_id"], "t", "start_s", "end_s", 20.0).groupBy("conv_id", "t").agg(how("turn").alias("turn"))
    return points.join(held, ["conv_id", "t"], "left").select("conv_id", F.round("t", 4).alias("t"), F.coalesce("turn", F.lit(-1)).alias("turn"))


def utterance_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, F.min)


def subtask_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, F.max)


def band_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.series(spark, sf_dir)
    errors, bought = rows.where("event_type = 'error'").select("user_id", "t"), rows.where("event_type = 'purchase'").select("user_id", F.col("t").alias("other"))
    return S.band_join(errors, bought, ["user_id"], "t", "other", 7200.0).select("user_id", F.round("t", 4).alias("t"), F.round("other", 4).alias("other"))


def non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.intervals(spark, sf_dir).withColumn("end_s", F.col("end_s") + F.col("turn") % 3 * 4)
    return rounded(S.without_overlaps(turns, ["conv_id"], "start_s", "end_s"), 4, "start_s", "end_s").select("conv_id", "turn", "start_s", "end_s")


def _q(spark, sf_dir):
    return adapters.quaternions(spark, sf_dir).withColumns({"qn": G.canonical(G.normalized(F.col("q"))), "rn": G.canonical(G.normalized(F.col("r")))})


def quat_norm_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.quaternions(spark, sf_dir)
    return rows.groupBy("label").agg(F.round(F.max(F.abs(G.norm(F.col("q")) - 1)), 6).alias("norm_error"), F.count("*").alias("n"))


def quat_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.multiply(F.col("qn"), F.col("rn"))
    return _q(spark, sf_dir).select("vec_id", m.alias("m")).select("vec_id", *[F.round(f"m.{c}", 6).alias(c) for c in "wxyz"])


def quat_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q(spark, sf_dir).select("vec_id", F.round(G.angle_between(F.col("qn"), F.col("rn")), 5).alias("angle"))


def quat_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q(spark, sf_dir).select("vec_id", G.slerp(F.col("qn"), F.col("rn"), 0.3).alias("m")).select("vec_id", *[F.round(f"m.{c}", 5).alias(c) for c in "wxyz"])


def quat_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.to_matrix(F.col("qn"))
    return _q(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(f"r{i // 3}{i % 3}") for i, c in enumerate(m)])


def se3_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point taken to the frame of a pose (rotation q, translation from r) by the inverse, then back."""
    t = [F.col(f"r.{c}") for c in "xyz"]
    back, shift = G.inverse(G.to_matrix(F.col("qn")), t)
    rows = _q(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(f"t{i}") for i, c in enumerate(shift)], *[F.round(c, 6).alias(f"p{i}") for i, c in enumerate(G.transform(back, shift, [F.lit(1.0), F.lit(2.0), F.lit(3.0)]))])
    return rows


def project_pinhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = G.project(F.col("q.x"), F.col("q.y"), F.col("q.z") + 0.3, 500.0, 500.0, 320.0, 240.0)
    rows = adapters.quaternions(spark, sf_dir).withColumns({"u": u, "v": v}).where("u IS NOT NULL")
    return rows.select("vec_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round(G.outside_distance(F.col("u"), F.col("v"), 640.0, 480.0), 4).alias("outside"))


def interval_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adapters.intervals(spark, sf_dir)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), (F.col("start_s") - 5).alias("b0"), F.col("end_s").alias("b1"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(G.interval_iou(F.col("start_s"), F.col("end_s"), F.col("b0"), F.col("b1")), 6).alias("iou"))


def sagittal_ik(spark: SparkSession, sf_dir: str) -> DataFrame:
    hip, knee = G.two_link_ik(F.col("q.x"), F.col("q.y") + 0.4, 0.3, 0.25)
    return adapters.quaternions(spark, sf_dir).select("vec_id", F.round(hip, 5).alias("hip"), F.round(knee, 5).alias("knee"))


NAMES = [
    canonical_timeline, resample_linear, asof_nearest, densify_gaps, moving_average_edge, moving_average_zero, fixed_bins, motion_changepoints, hysteresis_contact, contact_events, path_descriptors,
    velocity_limits, jitter_max, duty_factor, presence_flicker, keep_last_n, stride_sample, evenly_sampled, frame_decimation, utterance_alignment, subtask_index, band_near, non_overlapping,
    quat_norm_error, quat_multiply, quat_angle, quat_slerp, quat_to_matrix, se3_inverse, project_pinhole, interval_iou, sagittal_ik,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


T = "WITH " + TRACKS_SQL.rstrip().rstrip(",")
SERIES = "series AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 - 1704067200.0 AS t, arg_max(value, event_id) AS v FROM events GROUP BY ALL)"
CLICKS = f"WITH {SERIES}, clicks AS (SELECT user_id, t, v FROM series WHERE event_type = 'click'),\ngrid AS (SELECT user_id, unnest(range(CAST(floor(max(t) / {GRID_S}) AS BIGINT) + 2)) * CAST({GRID_S} AS DOUBLE) AS t FROM clicks GROUP BY 1),\n" + """
around AS (
  SELECT g.user_id, g.t, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av
  FROM (grid g ASOF LEFT JOIN clicks b ON b.user_id = g.user_id AND b.t <= g.t) ASOF LEFT JOIN clicks a ON a.user_id = g.user_id AND a.t > g.t)
"""
TURNS = "turns AS (SELECT conv_id, turn, sum(length(coalesce(text, '')) / 10.0) OVER w AS end_s, end_s - length(coalesce(text, '')) / 10.0 AS start_s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
DAILY = f"""WITH {SERIES}, daily AS (
  SELECT u.user_id, b.bin, coalesce(avg(v), 0.0) AS v FROM (SELECT DISTINCT user_id FROM series) u CROSS JOIN (SELECT unnest(range(30)) AS bin) b
  LEFT JOIN series s ON s.user_id = u.user_id AND floor(s.t / 86400.0) = b.bin GROUP BY ALL)"""
POINTS = f"WITH {TURNS}, pts AS (SELECT conv_id, unnest(range(CAST(floor(max(end_s) / 3) AS BIGINT) + 1)) * CAST(3.0 AS DOUBLE) AS t FROM turns GROUP BY 1)"
CONTACT = """WITH c AS (SELECT vec_id // 50 AS object_id, vec_id AS frame, abs(CAST(embedding[1] AS DOUBLE)) / 10 AS d FROM embeddings),
e AS (SELECT *, CASE WHEN d > 0.02 THEN 0 WHEN d < 0.012 AND lead(d) OVER w < 0.012 THEN 1 END AS ev FROM c WINDOW w AS (PARTITION BY object_id ORDER BY frame)),
k AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) = 1 AS contact FROM e)"""
QUAT = """WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
n AS (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS qn, sqrt(e[5]*e[5]+e[6]*e[6]+e[7]*e[7]+e[8]*e[8]) AS rn FROM e),
q AS (SELECT *, CASE WHEN e[1] < 0 THEN -qn ELSE qn END AS qs, CASE WHEN e[5] < 0 THEN -rn ELSE rn END AS rs,
  e[1]/qs AS w, e[2]/qs AS x, e[3]/qs AS y, e[4]/qs AS z, e[5]/rs AS w2, e[6]/rs AS x2, e[7]/rs AS y2, e[8]/rs AS z2 FROM n)"""


def oracle_sql() -> dict[str, str]:
    ma = lambda body: T + f" SELECT episode_id, is_person, track_id, frame, round({body}, 5) AS cx FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame)"
    mat = ["1-2*(y*y+z*z)", "2*(x*y-z*w)", "2*(x*z+y*w)", "2*(x*y+z*w)", "1-2*(x*x+z*z)", "2*(y*z-x*w)", "2*(x*z-y*w)", "2*(y*z+x*w)", "1-2*(x*x+y*y)"]
    inv = lambda i, p: " + ".join(f"({mat[3 * j + i]}) * ({p[j]})" for j in range(3))
    shift = [f"-({inv(i, ('e[6]', 'e[7]', 'e[8]'))})" for i in range(3)]
    return {
        "canonical_timeline": f"WITH {TURNS}, d AS (SELECT conv_id, max(end_s) AS d FROM turns GROUP BY 1), g AS (SELECT conv_id, unnest(range(CAST(floor(d * 0.5 + 1e-9) AS BIGINT) + 1)) AS i FROM d) SELECT conv_id, i, round(i / 0.5, 6) AS t FROM g",
        "resample_linear": CLICKS + f""", r AS (SELECT *, coalesce(abs(bt - t) <= 1e-6, false) AS eb, coalesce(abs(nt - t) <= 1e-6, false) AS ea, coalesce(nt - bt <= {GAP_S} + 1e-6, false) AS ok FROM around)
            SELECT user_id, t, round(CASE WHEN ea THEN av WHEN eb THEN bv WHEN ok THEN (1 - (t - bt) / (nt - bt)) * bv + (t - bt) / (nt - bt) * av ELSE coalesce(bv, av) END, 6) AS v, NOT (ea OR eb) AND ok AS interpolated, ea OR eb OR ok AS valid FROM r""",
        "asof_nearest": CLICKS + f""", p AS (SELECT *, nt IS NULL OR coalesce(t - bt <= nt - t, false) AS first FROM around), m AS (SELECT user_id, t, CASE WHEN first THEN bt ELSE nt END AS mt, CASE WHEN first THEN bv ELSE av END AS mv FROM p)
            SELECT user_id, t, round(CASE WHEN abs(mt - t) <= {GAP_S / 4} THEN mt END, 6) AS matched_t, round(CASE WHEN abs(mt - t) <= {GAP_S / 4} THEN mv END, 6) AS v FROM m""",
        "densify_gaps": T + """, s AS (SELECT *, CASE WHEN next_frame - frame BETWEEN 2 AND 3 THEN next_frame - frame - 1 ELSE 0 END AS last FROM nxt), k AS (SELECT *, unnest(range(last + 1)) AS k FROM s)
            SELECT episode_id, is_person, track_id, frame + k AS frame, round(CASE WHEN k = 0 THEN cx ELSE (1 - k / (next_frame - frame)) * cx + k / (next_frame - frame) * next_cx END, 5) AS cx,
              round(CASE WHEN k = 0 THEN cy ELSE (1 - k / (next_frame - frame)) * cy + k / (next_frame - frame) * next_cy END, 5) AS cy, k > 0 AS filled FROM k""",
        "moving_average_edge": T + """, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY track_id) AS n, first_value(cx) OVER w AS a, last_value(cx) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
              sum(cx) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame))
            SELECT episode_id, is_person, track_id, frame, round((s + greatest(0, 3 - rn) * a + greatest(0, 2 - (n - rn)) * z) / 5.0, 5) AS cx FROM n""",
        "moving_average_zero": ma("sum(cx) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0"),
        "fixed_bins": DAILY + " SELECT user_id, bin, round(v, 6) AS v FROM daily",
        "motion_changepoints": DAILY + ", s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY bin)) AS step FROM daily), l AS (SELECT *, avg(step) OVER (PARTITION BY user_id) + 1.5 * stddev_pop(step) OVER (PARTITION BY user_id) AS lim FROM s) SELECT user_id, bin, round(step, 4) AS step FROM l WHERE step > lim",
        "hysteresis_contact": CONTACT + " SELECT object_id, frame, contact FROM k",
        "contact_events": CONTACT + ", g AS (SELECT *, coalesce(lag(contact) OVER w, false) AS b, coalesce(lead(contact) OVER w, false) AS a FROM k WINDOW w AS (PARTITION BY object_id ORDER BY frame)) SELECT object_id, count(*) FILTER (contact AND NOT b) AS onsets, count(*) FILTER (contact AND NOT a) AS offsets, count(*) FILTER (contact) AS rows_on FROM g GROUP BY 1",
        "path_descriptors": T + """, s AS (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
            m AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, CASE WHEN sqrt(dx * dx + dy * dy) > 0.001 THEN {'x': dx, 'y': dy} END AS mv FROM s),
            p AS (SELECT *, last_value(mv IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM m),
            g AS (SELECT episode_id, is_person, track_id, count(*) AS n, coalesce(sum(d), 0) AS length, sqrt(pow(arg_max(cx, frame) - arg_min(cx, frame), 2) + pow(arg_max(cy, frame) - arg_min(cy, frame), 2)) AS net, count(*) FILTER (d > 0.001 AND dx * e.x + dy * e.y < 0) AS turns FROM p GROUP BY ALL)
            SELECT episode_id, is_person, track_id, n, round(length, 4) AS length, round(net, 4) AS net, turns, round(CASE WHEN length = 0 THEN 0 ELSE net / length END, 4) AS straightness FROM g""",
        "velocity_limits": f"WITH {SERIES}, c AS (SELECT *, t - lag(t) OVER w AS dt, abs(v - lag(v) OVER w) AS dv FROM series WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, CASE WHEN dt > 0 THEN dv / dt END AS speed FROM c), a AS (SELECT *, CASE WHEN dt > 0 THEN abs(speed - lag(speed) OVER (PARTITION BY user_id ORDER BY t)) / dt END AS acc FROM s) SELECT user_id, count(*) AS n, count(*) FILTER (speed > 0.005) AS vel_spikes, count(*) FILTER (acc > 1e-6) AS acc_spikes FROM a GROUP BY 1",
        "jitter_max": T + ", s AS (SELECT *, abs(lead(cx) OVER w - 2 * cx + lag(cx) OVER w) AS d2, lead(frame) OVER w - frame AS dt FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT episode_id, is_person, track_id, round(max(d2) / (median(dt) * median(dt)), 4) AS jitter FROM s GROUP BY ALL HAVING count(*) >= 3 AND median(dt) > 0",
        "duty_factor": f"WITH {SERIES}, m AS (SELECT event_type, median(v) AS m FROM series GROUP BY 1) SELECT event_type, round(1 - avg(CASE WHEN v > m THEN 1.0 ELSE 0.0 END), 6) AS duty FROM series JOIN m USING (event_type) GROUP BY 1",
        "presence_flicker": DAILY + ", s AS (SELECT *, abs(CASE WHEN v / 50 > 0.5 THEN 1 ELSE 0 END - lag(CASE WHEN v / 50 > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY bin)) AS d FROM daily) SELECT user_id, round(coalesce(avg(d), 0), 6) AS flicker FROM s GROUP BY 1",
        "keep_last_n": "SELECT user_id, CAST(place AS INTEGER) AS place, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 5",
        "stride_sample": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY user_id) // 10) AS k FROM events) WHERE i % k = 0",
        "evenly_sampled": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE list_contains([CAST(floor(j * (n - 1) / greatest(least(6, n) - 1, 1)) AS BIGINT) FOR j IN range(least(6, n))], i)",
        "frame_decimation": T + " SELECT episode_id, is_person, track_id, frame FROM tracks WHERE floor(ceil(frame / 2.5) * 2.5) = frame",
        "utterance_alignment": POINTS + " SELECT conv_id, round(t, 4) AS t, coalesce((SELECT min(turn) FROM turns x WHERE x.conv_id = pts.conv_id AND end_s > start_s AND pts.t BETWEEN start_s AND end_s), -1) AS turn FROM pts",
        "subtask_index": POINTS + " SELECT conv_id, round(t, 4) AS t, coalesce((SELECT max(turn) FROM turns x WHERE x.conv_id = pts.conv_id AND end_s > start_s AND pts.t BETWEEN start_s AND end_s), -1) AS turn FROM pts",
        "band_near": f"WITH {SERIES} SELECT a.user_id, round(a.t, 4) AS t, round(b.t, 4) AS other FROM series a JOIN series b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 7200",
        "non_overlapping": f"WITH {TURNS}, w AS (SELECT conv_id, turn, start_s, end_s + turn % 3 * 4 AS end_s FROM turns), c AS (SELECT *, greatest(start_s, coalesce(max(end_s) OVER (PARTITION BY conv_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_s)) AS s FROM w) SELECT conv_id, turn, round(s, 4) AS start_s, round(end_s, 4) AS end_s FROM c WHERE s < end_s",
        "quat_norm_error": QUAT + " SELECT label, round(max(abs(qn - 1)), 6) AS norm_error, count(*) AS n FROM q GROUP BY 1",
        "quat_multiply": QUAT + ", m AS (SELECT vec_id, w*w2-x*x2-y*y2-z*z2 AS a, w*x2+x*w2+y*z2-z*y2 AS b, w*y2-x*z2+y*w2+z*x2 AS c, w*z2+x*y2-y*x2+z*w2 AS d FROM q) SELECT vec_id, round(CASE WHEN a < 0 THEN -a ELSE a END, 6) AS w, round(CASE WHEN a < 0 THEN -b ELSE b END, 6) AS x, round(CASE WHEN a < 0 THEN -c ELSE c END, 6) AS y, round(CASE WHEN a < 0 THEN -d ELSE d END, 6) AS z FROM m",
        "quat_angle": QUAT + " SELECT vec_id, round(2 * acos(least(1.0, abs(w*w2+x*x2+y*y2+z*z2))), 5) AS angle FROM q",
        "quat_slerp": QUAT + ", s AS (SELECT *, w*w2+x*x2+y*y2+z*z2 AS dt, acos(least(1.0, abs(dt))) AS th, sin(0.7 * th) / sin(th) AS wp, sin(0.3 * th) / sin(th) * CASE WHEN dt < 0 THEN -1 ELSE 1 END AS wq FROM q), m AS (SELECT vec_id, wp*w+wq*w2 AS a, wp*x+wq*x2 AS b, wp*y+wq*y2 AS c, wp*z+wq*z2 AS d, sqrt(a*a+b*b+c*c+d*d) AS n FROM s) SELECT vec_id, round(a/n, 5) AS w, round(b/n, 5) AS x, round(c/n, 5) AS y, round(d/n, 5) AS z FROM m",
        "quat_to_matrix": QUAT + " SELECT vec_id, " + ", ".join(f"round({m}, 6) AS r{i // 3}{i % 3}" for i, m in enumerate(mat)) + " FROM q",
        "se3_inverse": QUAT + " SELECT vec_id, " + ", ".join(f"round({shift[i]}, 6) AS t{i}, round({inv(i, ('1.0', '2.0', '3.0'))} + {shift[i]}, 6) AS p{i}" for i in range(3)) + " FROM q",
        "project_pinhole": QUAT + ", p AS (SELECT vec_id, 500 * e[2] / (e[4] + 0.3) + 320 AS u, 500 * e[3] / (e[4] + 0.3) + 240 AS v FROM e WHERE e[4] + 0.3 > 1e-6) SELECT vec_id, round(u, 4) AS u, round(v, 4) AS v, round(sqrt(pow(greatest(-u, u - 640, 0), 2) + pow(greatest(-v, v - 480, 0), 2)), 4) AS outside FROM p",
        "interval_iou": f"WITH {TURNS}, p AS (SELECT a.conv_id, a.turn, a.start_s AS a0, a.end_s AS a1, b.start_s - 5 AS b0, b.end_s AS b1 FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN greatest(a1, b1) - least(a0, b0) > 1e-9 THEN greatest(0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) ELSE 0 END, 6) AS iou FROM p",
        "sagittal_ik": QUAT + ", r AS (SELECT vec_id, e[2] AS dx, e[3] + 0.4 AS dz, least(greatest(sqrt(pow(e[2], 2) + pow(e[3] + 0.4, 2)), 0.05 + 1e-6), 0.55 - 1e-6) AS r FROM e) SELECT vec_id, round(atan2(dx, dz) + acos(least(greatest((0.3*0.3 + r*r - 0.25*0.25) / (2*0.3*r), -1.0), 1.0)), 5) AS hip, round(acos(least(greatest((0.3*0.3 + 0.25*0.25 - r*r) / (2*0.3*0.25), -1.0), 1.0)) - pi(), 5) AS knee FROM r",
    }
