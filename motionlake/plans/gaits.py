"""Queries of four-legged gaits; keypoints are pairs of a vector's elements, clips fifty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import gaits as G
from .gate import rounded

KEY, FPS = ["episode_id"], 30.0
#: Where the keypoints of the view stand; elements 2k and 2k + 1 of a vector move the k-th one.
PLACES = {
    "back_base": (60.0, 0.0), "neck_base": (80.0, -5.0), "tail_base": (-60.0, 0.0), "back_end": (-50.0, 4.0),
    **{name: ((40.0 if leg[0] == "F" else -40.0) + 3 * i, 10.0 + 20 * i) for leg, names in G.LEGS.items() for i, name in enumerate(names)},
}
#: Pixels for a unit of an element, feet's hips, stance, gains and scale of a robot.
MOVED, HIP, STANCE, GAIN, LIFT, SCALE = 40.0, {"FL": (0.19, 0.14), "FR": (0.19, -0.14), "RL": (-0.19, 0.14), "RR": (-0.19, -0.14)}, 0.27, 0.6, 0.8, 0.4


def _keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips 3, 7, ... lack the fore anchors; the first one is missing in most frames of clips 1, 5, ...; paws are missing now and then."""
    which = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(u).alias("u"), F.lit(v).alias("v")) for k, (n, (u, v)) in enumerate(PLACES.items())]))
    rows = adapters._frames(spark, sf_dir).withColumn("w", which)
    clip, frame, name = F.col("episode_id") % 4, F.col("frame"), F.col("w.name")
    gone = ((clip == 3) & name.isin(*G.FORE)) | ((clip == 1) & (name == G.FORE[0]) & (frame % 3 != 0)) | (name.endswith("paw") & ((frame + F.col("w.k")) % 13 == 5))
    x, y = F.get("e", 2 * F.col("w.k")), F.get("e", 2 * F.col("w.k") + 1)
    return rows.where(~gone).select("episode_id", "frame", "t", name.alias("name"), (F.col("w.u") + MOVED * x).alias("u"), (F.col("w.v") + MOVED * y).alias("v"), F.least(F.lit(1.0), 0.4 + F.abs(x)).alias("conf"))


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leg_series(G.body_frames(_keypoints(spark, sf_dir), KEY), KEY)


def leg_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_legs(spark, sf_dir), 6, "t", "x", "y", "thigh_angle", "knee_angle", "conf")


def leg_duty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.leg_summary(_legs(spark, sf_dir), KEY), 6, "amplitude", "duty", "conf")


def foot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hip = F.create_map(*[x for leg, (u, v) in HIP.items() for x in (F.lit(leg), F.struct(F.lit(u).alias("x"), F.lit(v).alias("y"), F.lit(0.0).alias("z")))])
    return rounded(G.foot_targets(_legs(spark, sf_dir), KEY, hip[F.col("leg")], STANCE, GAIN, LIFT, SCALE), 6, "x", "y", "z")


def gait_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.gait_summary(_keypoints(spark, sf_dir), "episode_id", "long", FPS), 6, "period", "speed", *G.LEGS)


NAMES = [leg_series, leg_duty, foot_targets, gait_summary]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _smooth(column: str, win: int = G.SMOOTH) -> str:
    """Mean of a window whose ends repeat; as it is in shorter series."""
    h, w = win // 2, "PARTITION BY episode_id, leg ORDER BY frame"
    return f"""CASE WHEN n < {win} THEN {column} ELSE (sum({column}) OVER ({w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) + greatest(0, {h + 1} - rn) * first({column}) OVER ({w})
      + greatest(0, {h} - (n - rn)) * last({column}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {win}.0 END AS {column}"""


def _legs_sql() -> str:
    places = ", ".join(f"({k}, '{n}', {u}, {v})" for k, (n, (u, v)) in enumerate(PLACES.items()))
    legs = ", ".join(f"('{leg}', '{a}', '{b}', '{c}')" for leg, (a, b, c) in G.LEGS.items())
    seen = lambda n: f"count(*) FILTER (name = '{n}') > 0.5 * count(DISTINCT frame)"
    choose = lambda names: f"CASE WHEN {seen(names[0])} THEN '{names[0]}' WHEN {seen(names[1])} THEN '{names[1]}' END"
    n = adapters.EPISODE_FRAMES
    return f"""WITH em AS (SELECT vec_id // {n} AS episode_id, vec_id % {n} AS frame, (vec_id % {n}) / 30.0 AS t, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
kp AS (SELECT episode_id, frame, t, name, u + {MOVED} * e[2 * k + 1] AS u, v + {MOVED} * e[2 * k + 2] AS v, least(1.0, 0.4 + abs(e[2 * k + 1])) AS conf FROM em CROSS JOIN (VALUES {places}) AS p(k, name, u, v)
  WHERE NOT (episode_id % 4 = 3 AND name IN {G.FORE} OR episode_id % 4 = 1 AND name = '{G.FORE[0]}' AND frame % 3 <> 0 OR name LIKE '%paw' AND (frame + k) % 13 = 5)),
an AS (SELECT episode_id, {choose(G.FORE)} AS fore, {choose(G.HIND)} AS hind FROM kp GROUP BY 1),
ax AS (SELECT k.episode_id, k.frame, fore IS NOT NULL AND hind IS NOT NULL AS framed, max(u) FILTER (name = fore) - max(u) FILTER (name = hind) AS ax, max(v) FILTER (name = fore) - max(v) FILTER (name = hind) AS ay,
  avg(u) FILTER (name LIKE '%thai') AS hu, avg(v) FILTER (name LIKE '%thai') AS hv FROM kp k JOIN an USING (episode_id) GROUP BY ALL),
fr AS (SELECT *, CASE WHEN framed THEN median(sqrt(ax * ax + ay * ay)) OVER (PARTITION BY episode_id) ELSE 1 END AS body, sqrt(ax * ax + ay * ay) AS len FROM ax),
lg AS (SELECT leg, a.episode_id, a.frame, a.t, c.u AS pu, c.v AS pv, b.u - a.u AS tx, b.v - a.v AS ty, c.u - b.u AS sx, c.v - b.v AS sy, least(a.conf, b.conf, c.conf) AS conf FROM (VALUES {legs}) AS l(leg, n1, n2, n3)
  JOIN kp a ON a.name = n1 JOIN kp b ON b.name = n2 AND b.episode_id = a.episode_id AND b.frame = a.frame JOIN kp c ON c.name = n3 AND c.episode_id = a.episode_id AND c.frame = a.frame),
raw AS (SELECT episode_id, leg, frame, t, CASE WHEN framed THEN ((pu - hu) * ax + (pv - hv) * ay) / len / body ELSE pu END AS x, CASE WHEN framed THEN ((pv - hv) * ax - (pu - hu) * ay) / len / body ELSE -pv END AS y,
  atan2(ty, tx) AS thigh_angle, acos(least(greatest(-(tx * sx + ty * sy) / (sqrt(tx * tx + ty * ty) * sqrt(sx * sx + sy * sy) + 1e-9), -1), 1)) AS knee_angle, conf,
  row_number() OVER (PARTITION BY episode_id, leg ORDER BY frame) AS rn, count(*) OVER (PARTITION BY episode_id, leg) AS n FROM lg JOIN fr USING (episode_id, frame)),
legs AS (SELECT episode_id, leg, frame, t, {_smooth('x')}, {_smooth('y')}, {_smooth('thigh_angle')}, {_smooth('knee_angle')}, conf FROM raw)"""


def oracle_sql() -> dict[str, str]:
    legs = _legs_sql()
    hips = "CASE leg " + " ".join(f"WHEN '{leg}' THEN {{v[{i}]}}" for i, leg in enumerate(HIP)) + " END"
    side = lambda k: hips.format(v=[p[k] for p in HIP.values()])
    r = lambda *names: ", ".join(f"round({c}, 6) AS {c}" for c in names)
    return {
        "leg_series": legs + f" SELECT episode_id, leg, frame, {r('t', 'x', 'y', 'thigh_angle', 'knee_angle', 'conf')} FROM legs",
        "leg_duty": legs
        + """, m AS (SELECT *, y > median(y) OVER (PARTITION BY episode_id, leg) AS swings FROM legs),
            g AS (SELECT episode_id, leg, stddev_pop(y) AS amplitude, 1 - avg(CAST(swings AS INTEGER)) AS duty, avg(conf) AS conf FROM m GROUP BY ALL)
            SELECT episode_id, leg, round(amplitude, 6) AS amplitude, round(duty, 6) AS duty, round(conf, 6) AS conf, row_number() OVER (PARTITION BY episode_id ORDER BY amplitude DESC, leg) = 1 AS reference FROM g""",
        "foot_targets": legs
        + f""", m AS (SELECT *, x - avg(x) OVER w AS f, y - median(y) OVER w AS l FROM legs WINDOW w AS (PARTITION BY episode_id, leg))
            SELECT episode_id, leg, frame, round({side(0)} + f * {GAIN} * {SCALE}, 6) AS x, CAST({side(1)} AS DOUBLE) AS y, round(greatest(l * {LIFT} * {SCALE}, 0) - {STANCE}, 6) AS z FROM m""",
    }
