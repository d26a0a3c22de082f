"""Queries of fused channels and motion primitives; a clip is a user, a second a day, a channel a kind of event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import fusion as S
from ..operators.kinematics import nearest

KEY = ["user_id"]
SUBJECT, CAMERA, WRIST, APERTURE, OBJECTS = CHANNELS = ["flow_subject_px_s", "flow_camera_px_s", "wrist_speed_m_s", "hand_aperture_m", "object_speed_frac_s"]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = adapters.series(spark, sf_dir).withColumn("t", F.col("t") / 86400)
    kind = lambda name: series.where(F.col("event_type") == name)
    parts = [
        S.channel(S.per_second(kind("click"), KEY, "t", "v"), KEY, SUBJECT, hold=True),
        S.channel(S.per_second(kind("view"), KEY, "t", "v"), KEY, CAMERA, hold=True),
        S.channel(S.speeds(kind("signup"), KEY, "t", ["v", "k"], 4), KEY, WRIST),
        S.channel(kind("purchase"), KEY, APERTURE),
        S.channel(S.speeds(kind("error").withColumn("track", F.col("k") % 3), KEY, "t", ["v", "k"], 3, "track"), KEY, OBJECTS),
    ]
    clips = series.groupBy(*KEY).agg(F.max("t").alias("duration"))
    return S.on_grid(reduce(DataFrame.unionByName, parts), clips, KEY)


def channel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("user_id", "channel", "i", F.round("t", 6).alias("t"), F.round("v", 8).alias("v"))


def _told(found: DataFrame) -> DataFrame:
    names = F.map_keys("means")
    return found.withColumn("channels", F.array_join(F.transform(names, lambda c: c), ",")).withColumn("level", nearest("level", 8)).drop("means")


def grid_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each second."""
    grid = _grid(spark, sf_dir).withColumn("second", F.floor(F.col("i") / 10).cast("long"))
    return _told(S.segment_levels(grid, KEY, "second", SUBJECT)).drop("dominant")


def motion_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(S.primitives(_grid(spark, sf_dir), "user_id", CHANNELS, SUBJECT))


NAMES = [channel_grid, grid_activity, motion_primitives]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _speed(kind: str, least: int, track: str) -> str:
    inner = f"SELECT user_id, t, sqrt(pow(v - lag(v) OVER w, 2) + pow(k - lag(k) OVER w, 2)) / greatest(t - lag(t) OVER w, 1e-6) AS v, count(*) OVER (PARTITION BY user_id, {track}) AS n FROM e WHERE event_type = '{kind}' WINDOW w AS (PARTITION BY user_id, {track} ORDER BY t)"
    return f"SELECT user_id, t, v FROM ({inner}) WHERE n >= {least} AND v IS NOT NULL"


GRID_SQL = f"""WITH e AS (SELECT user_id, event_type, (epoch_us(ts) / 1e6 - 1704067200.0) / 86400 AS t, arg_max(value, event_id) AS v, CAST(arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), event_id) AS DOUBLE) AS k FROM events GROUP BY user_id, event_type, ts),
s AS (SELECT user_id, '{SUBJECT}' AS channel, true AS hold, floor(t) + 0.5 AS t, avg(v) AS v FROM e WHERE event_type = 'click' GROUP BY user_id, floor(t)
  UNION ALL SELECT user_id, '{CAMERA}', true, floor(t) + 0.5, avg(v) FROM e WHERE event_type = 'view' GROUP BY user_id, floor(t)
  UNION ALL SELECT user_id, '{APERTURE}', false, t, v FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, '{WRIST}', false, t, v FROM ({_speed('signup', 4, 'event_type')})
  UNION ALL SELECT user_id, '{OBJECTS}', false, t, v FROM ({_speed('error', 3, 'k % 3')})),
cells AS (SELECT user_id, unnest(range(CAST(ceil(greatest(max(t), 0.2) / 0.1) AS BIGINT))) AS i FROM e GROUP BY user_id),
g AS (SELECT c.user_id, channel, hold, i, i * CAST(0.1 AS DOUBLE) AS x FROM cells c JOIN (SELECT DISTINCT user_id, channel, hold FROM s) USING (user_id)),
b AS (SELECT g.*, s.t AS bt, s.v AS bv FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.channel = s.channel AND g.x >= s.t),
a AS (SELECT b.*, s.t AS nt, s.v AS nv FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.channel = s.channel AND b.x < s.t),
grid AS (SELECT user_id, channel, i, x AS t, CASE WHEN bt IS NULL THEN CASE WHEN hold THEN nv ELSE 0 END WHEN nt IS NULL AND x > bt THEN CASE WHEN hold THEN bv ELSE 0 END WHEN nt IS NULL THEN bv ELSE (nv - bv) / (nt - bt) * (x - bt) + bv END AS v FROM a)"""


def oracle_sql() -> dict[str, str]:
    return {
        "channel_grid": GRID_SQL + " SELECT user_id, channel, i, round(t, 6) AS t, round(v, 8) AS v FROM grid",
        "grid_activity": GRID_SQL
        + f""", h AS (SELECT user_id, quantile_cont(v, 0.75) AS high FROM grid WHERE channel = '{SUBJECT}' GROUP BY 1),
            p AS (SELECT user_id, i // 10 AS second, coalesce(avg(v) FILTER (channel = '{SUBJECT}'), 0) AS level, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM grid GROUP BY ALL)
            SELECT user_id, second, CASE WHEN coalesce(high, 0) > 0 AND round(level, 4) > high THEN 'high_motion' WHEN round(level, 4) > greatest(coalesce(high, 0) * {S.LOW_SHARE}, {S.LOW_LEAST}) THEN 'low_motion' ELSE 'static' END AS activity, round(level, 8) AS level, channels FROM p LEFT JOIN h USING (user_id)""",
    }
