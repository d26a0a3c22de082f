"""Queries of the plausibility gate: motion, the ten checks, scores. SQL gives the same rows for comparison."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import checks, kinematics
from ..operators.kinematics import nearest
from ..schemas import BONES, WEIGHTS, Thresholds
from ..sources import shared

#: The views' tracks are coarse; these thresholds find something in them.
TH = replace(
    Thresholds(), jump_speed=1.2, persist_min_gap=1, mater_margin_s=0.0, mater_person_dist=0.08, tk_min_frames=1, tk_corr=0.3, tk_dist=0.02, bone_stretch_tol=0.2, bone_min_samples=5, float_ground_clearance=0.02, float_person_dist=0.03, skate_min_frames=2, skate_min_vx=0.5, skate_max_vy=0.5, ground_band=0.06,
    levit_min_s=0.1, float_min_s=0.1, float_max_speed=3.0, contact_min_frames=2, levit_max_vy=0.6,
)


class Clip:
    """The views that the checks read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.use(adapters.tracks(spark, sf_dir))

    def use(self, tracks: DataFrame) -> None:
        self.tracks = tracks
        self.clips = adapters.clips(tracks)
        self.kpts = adapters.keypoints(tracks)

    def checks(self, shared: bool = False) -> dict[str, DataFrame]:
        return checks.all_checks(self.tracks, self.kpts, self.clips, TH, shared)

    def violations(self) -> DataFrame:
        """Of all checks: the boxes are aggregated once and kept for them."""
        self.use(shared.held(self.tracks, "tracks"))
        return checks.union_all(self.checks(shared=True))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: nearest(c, digits) for c in columns})


def shown(violations: DataFrame) -> DataFrame:
    """Violations with frames as text, for comparison."""
    frames = F.array_join(F.transform("frames", lambda f: f.cast("string")), ",")
    return violations.select("episode_id", "type", nearest("severity", 6).alias("severity"), frames.alias("frames"), "is_person", "track_id", "label", "gate")


def track_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kinematics.centers(adapters.tracks(spark, sf_dir))
    return rounded(found, 4, "cx", "cy").select("episode_id", "is_person", "track_id", "label", "frame", "cx", "cy")


def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kinematics.camera_motion(kinematics.consecutive(adapters.tracks(spark, sf_dir)))
    return rounded(found, 4, "cam_x", "cam_y").select("episode_id", "frame", "cam_x", "cam_y", "n_tracks")


def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Clip(spark, sf_dir)
    return rounded(kinematics.velocities(c.tracks, c.clips), 6, "vx", "vy", "speed").select("episode_id", "is_person", "track_id", "frame", "vx", "vy", "speed")


def ground_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kinematics.ground_line(Clip(spark, sf_dir).kpts, TH), 4, "ground_y").select("episode_id", "ground_y")


def moving_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Clip(spark, sf_dir)
    vel = kinematics.velocities(c.tracks, c.clips)
    found = kinematics.runs(vel, kinematics.TRACK, "frame", F.col("speed") > 0.3, 2, worst=F.max("speed"))
    return rounded(found, 6, "worst").select("episode_id", "is_person", "track_id", "first", "last", "n", "worst")


def one_check(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(Clip(spark, sf_dir).checks()[name])

    return run


def all_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Clip(spark, sf_dir).violations())


def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Clip(spark, sf_dir)
    found = c.violations()
    return rounded(checks.clip_scores(found, c.clips, TH), 6, "score")


def top_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.top_violations(Clip(spark, sf_dir).violations())
    return found.select("episode_id", "place", "type", nearest("severity", 6).alias("severity"))


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Clip(spark, sf_dir)
    found = c.violations()
    return checks.evidence_summary(c.tracks, found)


def _layout() -> str:
    return ", ".join(f"({k}, {a}, {b})" for k, (a, b) in adapters.LAYOUT.items())


TRACKS_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
tracks AS (
  SELECT user_id // {adapters.CLIP_USERS} AS episode_id, user_id % 3 = 0 AS is_person, user_id AS track_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frame,
    min(value) AS x1, max(value) + 20 AS x2, CAST(4.0 * min(k) AS DOUBLE) AS y1, CAST(4.0 * max(k) + 20 AS DOUBLE) AS y2, count(*) AS n_events,
    CASE WHEN user_id % 3 = 0 THEN 'person' ELSE 'object_' || (user_id % 7) END AS label
  FROM ev GROUP BY user_id, 4),
cen AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM tracks),
nxt AS (SELECT *, lead(frame) OVER w AS next_frame, lead(cx) OVER w AS next_cx, lead(cy) OVER w AS next_cy FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
prs AS (SELECT * FROM nxt WHERE next_frame = frame + 1),
cam AS (SELECT episode_id, frame, median(next_cx - cx) AS cam_x, median(next_cy - cy) AS cam_y, count(*) AS n_tracks FROM prs GROUP BY ALL HAVING count(*) >= 3),
vel AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (
  SELECT p.*, coalesce(cam_x, 0) AS kx, coalesce(cam_y, 0) AS ky, (next_cx - cx - coalesce(cam_x, 0)) / 1000.0 * 6.0 AS vx, (next_cy - cy - coalesce(cam_y, 0)) / 1000.0 * 6.0 AS vy
  FROM prs p LEFT JOIN cam USING (episode_id, frame))),
"""

# The checks' SQL. sev(x) is the severity of a ratio; islands are numbered by row places.
GATE_SQL = (
    TRACKS_SQL
    + f"""
layout(kpt_idx, a, b) AS (VALUES {_layout()}),
kp AS (SELECT episode_id, track_id, frame, label, kpt_idx, x1 + CAST(a AS DOUBLE) * (x2 - x1) AS x, y1 + CAST(b AS DOUBLE) * (y2 - y1) AS y, least(1.0, CAST(0.4 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n_events) AS conf FROM tracks CROSS JOIN layout WHERE is_person),
ground AS (SELECT episode_id, quantile_cont(y, 0.9) AS ground_y FROM kp WHERE kpt_idx IN (15, 16) AND conf > 0.5 GROUP BY 1 HAVING count(*) >= 5),
wrist AS (SELECT episode_id, frame, track_id AS person, kpt_idx AS w, x AS wx, y AS wy FROM kp WHERE kpt_idx IN (9, 10) AND conf >= {TH.kpt_conf}),
c1 AS (
  SELECT episode_id, 'trajectory_jump' AS type, sev(speed / {TH.jump_speed}) AS severity, [frame, frame + 1] AS frames, is_person, track_id, label
  FROM vel WHERE speed > {TH.jump_speed} AND speed / 6.0 > {TH.jump_min_disp}),
torso AS (
  SELECT episode_id, track_id, frame, label, sqrt(pow((p[5].x + p[6].x) / 2 - (p[11].x + p[12].x) / 2, 2) + pow((p[5].y + p[6].y) / 2 - (p[11].y + p[12].y) / 2, 2)) AS torso,
    least(p[5].conf, p[6].conf, p[11].conf, p[12].conf) > {TH.kpt_conf} AS sure, p, count(*) OVER (PARTITION BY track_id) AS n_rows
  FROM (SELECT episode_id, track_id, frame, label, map(list(kpt_idx), list({{'x': x, 'y': y, 'conf': conf}})) AS p FROM kp GROUP BY ALL)),
bones(a, b, bone) AS (VALUES {", ".join(f"({a}, {b}, '{n}')" for a, b, n in BONES)}),
lengths AS (
  SELECT episode_id, track_id, label, frame, bone, length / greatest(torso, 0.001) AS norm FROM (
    SELECT *, sqrt(pow(p[a].x - p[b].x, 2) + pow(p[a].y - p[b].y, 2)) AS length FROM torso CROSS JOIN bones WHERE n_rows >= {TH.bone_min_samples} AND sure AND least(p[a].conf, p[b].conf) > {TH.kpt_conf})
  WHERE least(length, torso) > {TH.bone_min_len} * 1000),
refs AS (SELECT track_id, bone, quantile_cont(norm, 0.9) AS ref FROM lengths GROUP BY ALL HAVING count(*) >= {TH.bone_min_samples}),
c2 AS (
  SELECT episode_id, 'body_deformation' AS type, sev((max(norm / ref - 1) / {TH.bone_stretch_tol} + 1) / 2) AS severity, list(frame ORDER BY frame) AS frames, true AS is_person, track_id, label
  FROM lengths JOIN refs USING (track_id, bone) WHERE ref >= 0.001 AND norm / ref - 1 > {TH.bone_stretch_tol} GROUP BY episode_id, track_id, label, bone HAVING count(*) >= {TH.bone_min_events}),
foot AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(conf) OVER w AS nc FROM kp WHERE kpt_idx IN (15, 16) WINDOW w AS (PARTITION BY track_id, kpt_idx ORDER BY frame)),
skate AS (
  SELECT f.episode_id, f.track_id, f.kpt_idx, f.frame, f.label, abs(nx - x - kx) / 1000.0 * 6.0 AS fx,
    abs(y - ground_y) < {TH.ground_band} * 1000 AND abs(ny - y - ky) / 1000.0 * 6.0 < {TH.skate_max_vy} AND abs(nx - x - kx) / 1000.0 * 6.0 > {TH.skate_min_vx} AS flag
  FROM foot f JOIN vel v USING (track_id, frame) JOIN ground g ON g.episode_id = f.episode_id WHERE nf = f.frame + 1 AND conf >= {TH.kpt_conf} AND nc >= {TH.kpt_conf}),
c3 AS (
  SELECT episode_id, 'foot_skate' AS type, sev(max(fx) / {TH.skate_min_vx}) * 0.9 AS severity, list(frame ORDER BY frame) AS frames, true AS is_person, track_id, label
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY track_id, kpt_idx ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track_id, kpt_idx ORDER BY frame) AS rn FROM skate) WHERE flag)
  GROUP BY episode_id, track_id, label, kpt_idx, g HAVING count(*) >= {TH.skate_min_frames}),
carried AS (
  SELECT v.episode_id, v.track_id, v.frame, v.label, v.speed, min(CASE WHEN wx IS NOT NULL THEN sqrt(pow(greatest(x1 - wx, 0, wx - x2), 2) + pow(greatest(y1 - wy, 0, wy - y2), 2)) END) AS dist,
    v.speed > {TH.carried_min_speed} AND NOT (v.vy > 0 AND v.vy / greatest(v.speed, 0.000001) > {TH.fall_vy_ratio}) AS moving
  FROM vel v LEFT JOIN wrist w ON w.episode_id = v.episode_id AND w.frame = v.frame WHERE NOT is_person AND v.episode_id IN (SELECT episode_id FROM tracks WHERE is_person) GROUP BY ALL),
c4 AS (
  SELECT episode_id, 'contact_incoherence' AS type, sev(max(speed) / {TH.carried_min_speed}) * 0.9 AS severity, list(frame ORDER BY frame) AS frames, false AS is_person, track_id, label
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM carried) WHERE moving AND (dist IS NULL OR dist / 1000.0 > {TH.contact_dist}))
  GROUP BY episode_id, track_id, label, g HAVING count(*) >= {TH.contact_min_frames}),
c5 AS (
  SELECT episode_id, 'object_disappearance' AS type, sev(sqrt(pow(next_cx - cx, 2) + pow(next_cy - cy, 2)) / 1000.0 / {TH.persist_reappear_disp}) * 0.85 AS severity, [frame, next_frame] AS frames, is_person, track_id, label
  FROM nxt WHERE next_frame - frame - 1 >= greatest({TH.persist_min_gap}, floor({TH.persist_gap_s} * 6.0)) AND sqrt(pow(next_cx - cx, 2) + pow(next_cy - cy, 2)) / 1000.0 > {TH.persist_reappear_disp}),
hover AS (
  SELECT v.episode_id, v.track_id, v.frame, v.label, ground_y - y2 >= {TH.float_ground_clearance} * 1000 AND speed <= {TH.float_max_speed}
    AND NOT EXISTS (FROM cen p WHERE p.is_person AND p.episode_id = v.episode_id AND p.frame = v.frame AND sqrt(pow(p.cx - v.cx, 2) + pow(p.cy - v.cy, 2)) / 1000.0 < {TH.float_person_dist}) AS flag
  FROM vel v JOIN ground g ON g.episode_id = v.episode_id WHERE NOT is_person),
c6 AS (
  SELECT episode_id, 'gravity_suspicion' AS type, CAST(0.6 AS DOUBLE) AS severity, list(frame ORDER BY frame) AS frames, false AS is_person, track_id, label
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM hover) WHERE flag)
  GROUP BY episode_id, track_id, label, g HAVING count(*) >= greatest(2, floor({TH.float_min_s} * 6.0))),
ends AS (
  SELECT c.* EXCLUDE (n_events), 'head' AS e FROM cen c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame) = 1
  UNION ALL SELECT c.* EXCLUDE (n_events), 'tail' FROM cen c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) = 1),
c7 AS (
  SELECT episode_id, 'object_materialization' AS type, CAST(CASE WHEN e = 'head' THEN 0.75 ELSE 0.7 END AS DOUBLE) AS severity, [frame] AS frames, is_person, track_id, label
  FROM ends t WHERE CASE WHEN e = 'head' THEN frame > floor({TH.mater_margin_s} * 6.0) ELSE frame < 30 - floor({TH.mater_margin_s} * 6.0) END
    AND NOT (x1 < {TH.edge_margin} * 800 OR y1 < {TH.edge_margin} * 600 OR x2 > {1 - TH.edge_margin} * 800 OR y2 > {1 - TH.edge_margin} * 600)
    AND NOT EXISTS (
      FROM (SELECT *, lag(frame) OVER w AS before, lead(frame) OVER w AS after FROM cen WHERE is_person WINDOW w AS (PARTITION BY track_id ORDER BY frame)) p
      WHERE p.episode_id = t.episode_id AND abs(p.frame - t.frame) <= 2 AND NOT (t.is_person AND p.track_id = t.track_id)
        AND ((p.frame >= t.frame AND coalesce(p.before, -1) < t.frame) OR (p.frame < t.frame AND coalesce(p.after, t.frame) >= t.frame))
        AND sqrt(pow(p.cx - t.cx, 2) + pow(p.cy - t.cy, 2)) / 1000.0 < {TH.mater_person_dist})
    AND NOT EXISTS (
      FROM ends o WHERE o.episode_id = t.episode_id AND o.e <> t.e AND o.track_id <> t.track_id AND abs(o.frame - t.frame) <= greatest(2, floor({TH.idswitch_gap_s} * 6.0))
        AND sqrt(pow(o.cx - t.cx, 2) + pow(o.cy - t.cy, 2)) / 1000.0 < {TH.idswitch_dist})),
air AS (
  SELECT v.episode_id, v.track_id, v.frame, v.label, ground_y - a.low > {TH.levit_clearance} * 1000 AND abs(v.vy) < {TH.levit_max_vy} AS flag
  FROM vel v JOIN (SELECT track_id, frame, max(y) AS low, min(conf) AS sure FROM kp WHERE kpt_idx IN (15, 16) GROUP BY ALL) a ON a.track_id = v.track_id AND a.frame = v.frame AND sure >= {TH.kpt_conf}
  JOIN ground g ON g.episode_id = v.episode_id WHERE is_person),
c8 AS (
  SELECT episode_id, 'levitation' AS type, CAST(0.85 AS DOUBLE) AS severity, list(frame ORDER BY frame) AS frames, true AS is_person, track_id, label
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM air) WHERE flag)
  GROUP BY episode_id, track_id, label, g HAVING count(*) >= greatest(3, floor({TH.levit_min_s} * 6.0))),
near AS (
  SELECT v.track_id, v.frame, w.person, w.w, w.wx, w.wy, sqrt(pow(wx - cx, 2) + pow(wy - cy, 2)) AS dist FROM vel v JOIN wrist w ON w.episode_id = v.episode_id AND w.frame = v.frame
  WHERE NOT is_person AND speed >= {TH.tk_min_speed} QUALIFY row_number() OVER (PARTITION BY v.track_id, v.frame ORDER BY dist, person, w) = 1),
tele AS (
  SELECT v.episode_id, v.track_id, v.frame, v.label, coalesce(n.dist / 1000.0 >= {TH.tk_dist} AND hn >= 0.1 AND speed >= 0.000001 AND (hx * vx + hy * vy) > {TH.tk_corr} * hn * speed, false) AS flag
  FROM vel v LEFT JOIN (
    SELECT n.*, (l.wx - n.wx - kx) / 1000.0 * 6.0 AS hx, (l.wy - n.wy - ky) / 1000.0 * 6.0 AS hy, sqrt(hx * hx + hy * hy) AS hn
    FROM near n JOIN vel USING (track_id, frame) JOIN wrist l ON l.person = n.person AND l.w = n.w AND l.frame = n.frame + 1) n ON n.track_id = v.track_id AND n.frame = v.frame
  WHERE NOT is_person),
c9 AS (
  SELECT episode_id, 'telekinesis_suspicion' AS type, CAST(0.8 AS DOUBLE) AS severity, list(frame ORDER BY frame) AS frames, false AS is_person, track_id, label
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM tele) WHERE flag)
  GROUP BY episode_id, track_id, label, g HAVING count(*) >= {TH.tk_min_frames}),
c10 AS (
  SELECT episode_id, 'object_deformation' AS type, sev(max(step) / {TH.deform_log_aspect}) * 0.85 AS severity, list(frame ORDER BY frame) AS frames, false AS is_person, track_id, label
  FROM (SELECT *, CASE WHEN lag(frame) OVER w = frame - 1 THEN abs(ln((x2 - x1) / (y2 - y1)) - lag(ln((x2 - x1) / (y2 - y1))) OVER w) END AS step FROM tracks WHERE NOT is_person WINDOW w AS (PARTITION BY track_id ORDER BY frame))
  WHERE step > {TH.deform_log_aspect} GROUP BY episode_id, track_id, label HAVING count(*) >= {TH.deform_min_events}),
"""
).replace("sev(", "SEV(")

CHECKS = list(WEIGHTS)[:10]
SHOW = "SELECT episode_id, type, round(severity, 6) AS severity, array_to_string(frames, ',') AS frames, is_person, track_id, label, 'formal' AS gate"


def _expand(sql: str) -> str:
    """Write the severity of a ratio, SEV(ratio), out."""
    while (at := sql.find("SEV(")) >= 0:
        depth, end = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + f"least(greatest(0.5 + 0.25 * (({sql[at + 4 : end - 1]}) - 1.0), 0.5), 1.0)" + sql[end:]
    return sql


GATE = _expand(GATE_SQL)
ALL = GATE + "vio AS (" + " UNION ALL ".join(f"SELECT * FROM c{k + 1}" for k in range(10)) + "),\n"
WEIGHT_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0.1 END"
ORDER_SQL = f"list_position({list(WEIGHTS)}, type)"


def queries() -> dict:
    found = {"track_centers": track_centers, "camera_motion": camera_motion, "velocities": velocities, "ground_line": ground_line, "moving_runs": moving_runs}
    found |= {name: one_check(name) for name in CHECKS}
    return found | {"all_violations": all_violations, "clip_scores": clip_scores, "top_violations": top_violations, "evidence_summary": evidence_summary}


def oracle_sql() -> dict[str, str]:
    start = "WITH " + TRACKS_SQL.rstrip().rstrip(",")
    found = {
        "track_centers": start + " SELECT episode_id, is_person, track_id, label, frame, round(cx, 4) AS cx, round(cy, 4) AS cy FROM cen",
        "camera_motion": start + " SELECT episode_id, frame, round(cam_x, 4) AS cam_x, round(cam_y, 4) AS cam_y, n_tracks FROM cam",
        "velocities": start + " SELECT episode_id, is_person, track_id, frame, round(vx, 6) AS vx, round(vy, 6) AS vy, round(speed, 6) AS speed FROM vel",
        "ground_line": "WITH " + GATE.rstrip().rstrip(",") + " SELECT episode_id, round(ground_y, 4) AS ground_y FROM ground",
        "moving_runs": start
        + """ SELECT episode_id, is_person, track_id, min(frame) AS "first", max(frame) AS "last", count(*) AS n, round(max(speed), 6) AS worst FROM (
          SELECT *, rn - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn FROM vel) WHERE speed > 0.3)
          GROUP BY episode_id, is_person, track_id, g HAVING count(*) >= 2""",
        "all_violations": "WITH " + ALL.rstrip().rstrip(",") + f" {SHOW} FROM vio",
        "clip_scores": "WITH " + ALL + f"""
w AS (SELECT episode_id, type, max(severity) AS worst, count(*) AS n FROM vio GROUP BY ALL),
r AS (SELECT episode_id, sum({WEIGHT_SQL} * worst) AS loss, sum(n) AS n_violations, count(*) AS n_types, max(worst) AS top, arg_min(type, (-worst, {ORDER_SQL})) AS main, string_agg(type, ', ' ORDER BY type) AS types FROM w GROUP BY 1),
s AS (SELECT e.episode_id, greatest(0.0, least(1.0, 1 - coalesce(loss, 0))) AS score, coalesce(n_violations, 0) AS nv, coalesce(n_types, 0) AS nt, coalesce(top > {TH.critical_severity}, false) AS critical, main, types
  FROM (SELECT DISTINCT episode_id FROM tracks) e LEFT JOIN r USING (episode_id))
SELECT episode_id, round(score, 6) AS score, CAST(nv AS BIGINT) AS n_violations, CAST(nt AS BIGINT) AS n_types, critical, score >= {TH.accept_score} AND NOT critical AS plausible,
  CASE WHEN score >= {TH.accept_score} AND NOT critical THEN 'no critical inconsistency' WHEN critical THEN 'critical: ' || main ELSE types END AS reason FROM s""",
        "top_violations": "WITH " + ALL.rstrip().rstrip(",") + f"""
SELECT episode_id, CAST(place AS INTEGER) AS place, type, round(severity, 6) AS severity FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY severity DESC, {ORDER_SQL}, track_id, frames[1], array_to_string(frames, ',')) AS place FROM vio) WHERE place <= 8""",
        "evidence_summary": "WITH " + ALL + """
s AS (SELECT episode_id, count(DISTINCT track_id) FILTER (is_person) AS n_persons, count(DISTINCT track_id) FILTER (NOT is_person) AS n_objects, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (NOT is_person), '') AS object_labels FROM tracks GROUP BY 1)
SELECT s.*, coalesce(f.n, 0) AS n_suspicious, coalesce(v.n, 0) AS n_formal FROM s
LEFT JOIN (SELECT episode_id, count(DISTINCT f) AS n FROM (SELECT episode_id, unnest(frames) AS f FROM vio) GROUP BY 1) f USING (episode_id)
LEFT JOIN (SELECT episode_id, count(*) AS n FROM vio GROUP BY 1) v USING (episode_id)""",
    }
    for k, name in enumerate(CHECKS):
        found[name] = "WITH " + GATE.rstrip().rstrip(",") + f" {SHOW} FROM c{k + 1}"
    return found
