"""Queries of hands and objects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import manipulation as M
from ..schemas import VERBS
from .gate import rounded

EPISODE = ["episode_id"]
#: The views' hands are never within millimetres of an object.
ON, OFF, SUSTAIN = 0.12, 0.16, 2


def _contacts(spark, sf_dir):
    return M.infer_contacts(adapters.hands(spark, sf_dir), adapters.objects(spark, sf_dir), EPISODE, ON, OFF, SUSTAIN)


def hand_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_contacts(spark, sf_dir), 6, "t", "min_dist_m", "penetration_m", "conf")


def contact_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.touched(_contacts(spark, sf_dir), EPISODE)


def aperture_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.aperture(adapters.hands(spark, sf_dir), EPISODE), 6, "t", "aperture_m")


def hand_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.hand_metrics(adapters.hands(spark, sf_dir), EPISODE), 6, "mean_conf", "invalid_ratio", "min_aperture_m", "max_aperture_m")


def end_effectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.end_effectors(adapters.hands(spark, sf_dir), EPISODE), 6, "t", "px", "py", "pz", "conf", "aperture_m")


def _right_hand(spark, sf_dir):
    """Frames of the right hand and heights of the objects, as segments take them."""
    hands, objects = adapters.hands(spark, sf_dir), adapters.objects(spark, sf_dir)
    wrist = hands.where("hand = 'right' AND joint_name = 'wrist'").select("episode_id", "frame", "t", M.point("wrist"))
    reach = wrist.join(objects.select("episode_id", "frame", M.point("thing")), ["episode_id", "frame"], "left").groupBy("episode_id", "frame").agg(F.min("t").alias("t"), F.min(M.distance("wrist", "thing")).alias("reach"))
    on = M.touched(_contacts(spark, sf_dir), EPISODE).where("hand = 'right'").drop("hand")
    return reach.join(on, ["episode_id", "frame"]), objects.select("episode_id", "object_id", "frame", F.col("pz").alias("z"))


def subtask_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, heights = _right_hand(spark, sf_dir)
    found = M.subtask_segments(frames, heights, EPISODE, VERBS)
    return rounded(found.withColumn("place", F.col("place").cast("int")), 6, "start_s", "end_s")


NAMES = [hand_contacts, contact_by_hand, aperture_series, hand_metrics, end_effectors, subtask_segments]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _values(table: dict[str, int]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in table.items()) + ")"


N = adapters.EPISODE_FRAMES
EPISODES = f"""WITH em AS (SELECT vec_id // {N} AS episode_id, vec_id % {N} AS frame, (vec_id % {N}) / 30.0 AS t, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
hands AS (SELECT episode_id, frame, t, hand, joint_name, e[b + o + 1] AS px, e[b + o + 2] AS py, e[b + o + 3] AS pz, least(1.0, 0.4 + 2 * abs(e[b + o + 1])) AS conf
  FROM em CROSS JOIN {_values(adapters.HANDS)} AS h(hand, b) CROSS JOIN {_values(adapters.JOINTS)} AS j(joint_name, o)),
objs AS (SELECT episode_id, frame, t, object_id, e[b + 1] AS px, e[b + 2] AS py, e[b + 3] AS pz, least(1.0, 0.6 + abs(e[b + 8])) AS conf
  FROM em CROSS JOIN {_values(adapters.OBJECTS)} AS o(object_id, b) WHERE object_id = 'cup' OR frame % 7 <> 3)"""
CONTACTS = (
    EPISODES
    + f""",
near AS (SELECT h.episode_id, h.frame, hand, object_id, min(h.t) AS t, min(sqrt(pow(h.px - o.px, 2) + pow(h.py - o.py, 2) + pow(h.pz - o.pz, 2)) - {M.OBJECT_RADIUS_M}) AS gap, avg(h.conf) * any_value(o.conf) AS sure
  FROM hands h JOIN objs o ON o.episode_id = h.episode_id AND o.frame = h.frame GROUP BY ALL),
ev AS (SELECT *, CASE WHEN gap > {OFF} THEN 0 WHEN gap < {ON} AND lead(gap) OVER w < {ON} THEN 1 END AS ev FROM near WINDOW w AS (PARTITION BY episode_id, hand, object_id ORDER BY frame)),
con AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY episode_id, hand, object_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) = 1 AS contact FROM ev),
touched AS (SELECT episode_id, hand, frame, bool_or(contact) AS contact, min(CASE WHEN contact THEN object_id END) AS object_id FROM con GROUP BY ALL)"""
)
APERTURE = (
    EPISODES
    + """,
tips AS (SELECT a.episode_id, a.hand, a.frame, a.t, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2)) AS raw FROM hands a JOIN hands b ON a.episode_id = b.episode_id AND a.hand = b.hand AND a.frame = b.frame AND a.joint_name = 'thumbTip' AND b.joint_name = 'indexFingerTip'),
wide AS (SELECT episode_id, hand, frame, t, CASE WHEN count(*) OVER (PARTITION BY episode_id, hand) >= 5 THEN sum(raw) OVER (PARTITION BY episode_id, hand ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE raw END AS aperture_m FROM tips)"""
)
G, P = M.GRASP_FRAMES, M.PAUSE_FRAMES
SEGMENTS = (
    CONTACTS
    + f""",
frames AS (SELECT h.episode_id, h.frame, min(h.t) AS t, bool_or(c.contact) AS contact, min(c.object_id) AS object_id, min(sqrt(pow(h.px - o.px, 2) + pow(h.py - o.py, 2) + pow(h.pz - o.pz, 2))) AS reach
  FROM hands h JOIN touched c ON c.episode_id = h.episode_id AND c.frame = h.frame AND c.hand = 'right' LEFT JOIN objs o ON o.episode_id = h.episode_id AND o.frame = h.frame WHERE h.hand = 'right' AND joint_name = 'wrist' GROUP BY ALL),
fr AS (SELECT *, coalesce(lag(contact) OVER (PARTITION BY episode_id ORDER BY frame), false) AS before, max(frame) OVER (PARTITION BY episode_id) AS last,
  min(CASE WHEN NOT contact THEN frame END) OVER (PARTITION BY episode_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS off FROM frames),
rs AS (SELECT episode_id, frame AS r, coalesce(off, last) AS f, object_id, last, least(coalesce(off, last) + {G}, last) AS released FROM fr WHERE contact AND NOT before),
win AS (SELECT *, row_number() OVER o AS k, coalesce(lag(released) OVER o, 0) AS cur FROM rs WINDOW o AS (PARTITION BY episode_id ORDER BY r)),
ap AS (SELECT w.episode_id, k, count(*) AS n, max(reach) AS far, arg_min(f.frame, (-reach, f.frame)) AS far_at, arg_max(reach, f.frame) AS near FROM win w JOIN frames f ON f.episode_id = w.episode_id AND f.frame >= cur AND f.frame < r WHERE reach IS NOT NULL GROUP BY ALL),
lf AS (SELECT w.episode_id, k, max(o.pz) - arg_min(o.pz, o.frame) AS rise, arg_min(o.frame, (-o.pz, o.frame)) AS top FROM win w JOIN objs o ON o.episode_id = w.episode_id AND o.object_id = w.object_id AND o.frame BETWEEN r AND f GROUP BY ALL),
x AS (SELECT w.*, coalesce(rise > {M.LIFT_M}, false) AS lifts, top, CASE WHEN r > cur + 2 AND n >= 3 AND far - near > {M.REACH_M} THEN far_at ELSE cur END AS rc, least(r + {G}, f) AS held FROM win w LEFT JOIN ap USING (episode_id, k) LEFT JOIN lf USING (episode_id, k)),
y AS (SELECT *, CASE WHEN lifts AND top - r < f - r + 1 - {P} THEN top END AS split FROM x),
parts AS (
  SELECT episode_id, k, 0 AS i, cur AS a, rc AS b, 'idle' AS skill, 'waiting' AS text FROM y WHERE rc > cur + {P}
  UNION ALL SELECT episode_id, k, 1, rc, r, 'reach', 'reach toward ' || object_id FROM y
  UNION ALL SELECT episode_id, k, 2, r, held, 'grasp', 'grasp ' || object_id FROM y
  UNION ALL SELECT episode_id, k, 3, held, coalesce(split, f), CASE WHEN lifts THEN 'lift' ELSE 'hold' END, CASE WHEN lifts THEN 'lift ' ELSE 'hold ' END || object_id FROM y
  UNION ALL SELECT episode_id, k, 4, split, f, 'lower', 'lower ' || object_id FROM y WHERE split IS NOT NULL
  UNION ALL SELECT episode_id, k, 5, f, released, 'release', 'release ' || object_id FROM y
  UNION ALL SELECT c.episode_id, 1000000, 0, coalesce(w.released, 0), c.last, 'idle', 'waiting' FROM (SELECT episode_id, max(frame) AS last FROM frames GROUP BY 1) c LEFT JOIN (SELECT episode_id, max(released) AS released FROM win GROUP BY 1) w USING (episode_id)),
timed AS (SELECT p.*, s.t AS start_s, e.t AS end_s FROM parts p JOIN frames s ON s.episode_id = p.episode_id AND s.frame = a JOIN frames e ON e.episode_id = p.episode_id AND e.frame = b WHERE b > a),
flags AS (SELECT *, end_s - start_s >= {M.MIN_LEN_S} OR row_number() OVER (PARTITION BY episode_id ORDER BY k, i) = 1 AS long FROM timed),
isles AS (SELECT *, count(*) FILTER (long) OVER (PARTITION BY episode_id ORDER BY k, i ROWS UNBOUNDED PRECEDING) - 1 AS place FROM flags)
SELECT episode_id, CAST(place AS INTEGER) AS place, round(min(start_s), 6) AS start_s, round(arg_max(end_s, (k, i)), 6) AS end_s, arg_min(skill, (k, i)) AS skill, arg_min(text, (k, i)) AS text FROM isles GROUP BY episode_id, place"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "hand_contacts": CONTACTS + " SELECT episode_id, hand, object_id, frame, round(t, 6) AS t, contact, round(greatest(gap, 0), 6) AS min_dist_m, round(greatest(-gap, 0), 6) AS penetration_m, round(least(greatest(sure, 0), 1), 6) AS conf, true AS valid, 'estimated' AS source FROM con",
        "contact_by_hand": CONTACTS + " SELECT * FROM touched",
        "aperture_series": APERTURE + " SELECT episode_id, hand, frame, round(t, 6) AS t, round(aperture_m, 6) AS aperture_m FROM wide",
        "hand_metrics": APERTURE + " SELECT * FROM (SELECT episode_id, hand, round(avg(conf), 6) AS mean_conf, round(avg(CAST(conf < 0.5 AS INTEGER)), 6) AS invalid_ratio FROM hands GROUP BY ALL) JOIN (SELECT episode_id, hand, round(min(aperture_m), 6) AS min_aperture_m, round(max(aperture_m), 6) AS max_aperture_m FROM wide GROUP BY ALL) USING (episode_id, hand)",
        "end_effectors": APERTURE + " SELECT episode_id, hand, h.frame, round(h.t, 6) AS t, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, round(conf, 6) AS conf, round(aperture_m, 6) AS aperture_m FROM hands h LEFT JOIN wide w USING (episode_id, hand, frame) WHERE joint_name = 'wrist'",
        "subtask_segments": SEGMENTS,
    }
