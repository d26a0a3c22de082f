"""Queries of travel, detections, object summaries, banners and status folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import kinematics as K
from ..operators import motion as M
from ..operators import series as S
from .gate import TRACKS_SQL, rounded

LENGTH = 50.0


def _centers(spark, sf_dir):
    return K.centers(adapters.tracks(spark, sf_dir))


def travel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.travel(_centers(spark, sf_dir), K.TRACK, "frame", "cx", "cy", adapters.FPS, F.lit(LENGTH))
    return rounded(found.select(*K.TRACK, "frame", "speed", "yaw_rate", "path_conf"), 4, "speed", "yaw_rate", "path_conf")


def detection_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.detection_velocity(_centers(spark, sf_dir), K.TRACK, "frame", "cx", "cy", adapters.FPS)
    return rounded(found.select(*K.TRACK, "frame", "vx", "vy"), 4, "vx", "vy")


def quat_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.quaternions(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).cast("long").alias("series"), "vec_id", "q")
    found = M.continuous(rows, ["series"], "vec_id", "q")
    return found.select("vec_id", *[F.round(f"q.{c}", 6).alias(c) for c in "wxyz"])


def object_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centers(spark, sf_dir).where("NOT is_person")
    paths = S.path_descriptors(c, ["episode_id", "track_id"], "frame", "cx", "cy").select("episode_id", "track_id", (F.col("length") / 1000).alias("length"))
    found = M.object_tracks(c, ["episode_id", "track_id"], "frame", paths, (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), "label")
    return rounded(found.where(F.col("place") <= M.TRACKS_SHOWN), 4, "size_change_ratio", "length")


def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.series(spark, sf_dir).select("user_id", "event_type", (F.col("t") / 86400).alias("t"), (F.col("v") / 400).alias("conf"))
    queries = rows.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*[F.lit(x) for x in ("click", "view", "unicorn")])))
    found = M.hit_summary(queries, rows, "user_id", "event_type", "t", "conf")
    return found.withColumn("present_seconds", F.array_join(F.transform("present_seconds", lambda s: s.cast("string")), ","))


def violation_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
    rows = events.select("user_id", "event_type", F.array(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long")).alias("frames"))
    return M.banner(rows, ["user_id"], "frames", "event_type", 3).withColumn("types", F.array_join("types", ","))


def energy_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    return rounded(M.energy(events, ["user_id"], "event_id", "value", 7), 5, "energy")


def _logs(spark, sf_dir):
    """Events as log entries of their user's batch."""
    say = F.element_at(F.array(*[F.lit(x) for x in MESSAGES]), (F.col("event_id") % len(MESSAGES)).cast("int") + 1)
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warn").otherwise("info")
    agent = F.when(F.col("event_id") % 17 == 0, "verifier").when(F.col("event_id") % 19 == 0, "canvas")
    quiet = F.when((level == "error") & (F.col("user_id") % 3 != 0), "info").otherwise(level)
    return adapters.table(spark, sf_dir, "events").where("event_id % 40 < 8").select("user_id", "event_id", quiet.alias("level"), agent.alias("agent"), say.alias("message"))


MESSAGES = ["Starting agent pipeline from intent", "Parsing intent", "Building world contract", "planning 3 scenario variations", "Compiling prompts", "saved clip", "nothing to say", "Batch finished", "starting video job", "extracted tracks"]
STATUSES = ["running", "completed", "partial", "failed", "queued"]


def circuit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = adapters.table(spark, sf_dir, "events").select("user_id").distinct()
    batches = users.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("user_id") % 5).cast("int") + 1))
    return M.circuit_status(_logs(spark, sf_dir), batches, "user_id", "event_id")


def phase_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = adapters.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("phase"), F.when(F.col("event_type") == "click", F.col("value")).alias("accepted"), F.when(F.col("event_id") % 7 == 0, F.col("event_id")).alias("exported"))
    return M.phase_history(updates, "user_id", "event_id", "phase", ["accepted", "exported"]).withColumn("history", F.array_join("history", ","))


NAMES = [travel_profile, detection_velocity, quat_continuity, object_tracks, hit_summary, violation_banner, energy_envelope, circuit_status, phase_history]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


T = "WITH " + TRACKS_SQL.rstrip().rstrip(",")


def _smooth(column: str, win: int) -> str:
    """Mean of a window whose ends repeat; as it is in shorter series."""
    h = win // 2
    return f"CASE WHEN n < {win} THEN {column} ELSE (sum({column}) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) + greatest(0, {h + 1} - rn) * first({column}) OVER (PARTITION BY track_id ORDER BY frame) + greatest(0, {h} - (n - rn)) * last({column}) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {win}.0 END"


def _gradient(column: str) -> str:
    w = "OVER (PARTITION BY track_id ORDER BY frame)"
    return f"CASE WHEN rn > 1 AND rn < n THEN (lead({column}) {w} - lag({column}) {w}) / 2 WHEN rn < n THEN lead({column}) {w} - {column} ELSE {column} - lag({column}) {w} END"


def oracle_sql() -> dict[str, str]:
    rate, half = adapters.FPS, 6.283185307179586
    messages, statuses = str(MESSAGES), str(STATUSES)
    low = "lower(message)"
    stage = f"""CASE WHEN contains({low}, 'batch') AND contains({low}, 'finished') THEN 'export' WHEN contains({low}, 'starting') AND contains({low}, 'video job') THEN 'render' WHEN contains({low}, 'starting agent pipeline') OR contains({low}, 'batch ') THEN 'queue' WHEN contains({low}, 'saved ') THEN 'render'
        WHEN agent = 'verifier' OR contains({low}, 'extracted tracks') THEN 'verify' WHEN agent = 'canvas' OR contains({low}, 'compiling prompts') THEN 'prompts' WHEN contains({low}, 'planning ') THEN 'scenarios' WHEN contains({low}, 'contract') THEN 'contract' WHEN contains({low}, 'intent') THEN 'intent' END"""
    return {
        "travel_profile": T
        + f""", a AS (SELECT episode_id, is_person, track_id, frame, cx, cy, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS rn, count(*) OVER (PARTITION BY track_id) AS n FROM cen),
            b AS (SELECT *, {_smooth('cx', 7)} AS x, {_smooth('cy', 7)} AS y FROM a), c AS (SELECT *, ({_gradient('x')}) * {rate} AS vx, ({_gradient('y')}) * {rate} AS vy FROM b),
            d AS (SELECT *, sqrt(vx * vx + vy * vy) / {LENGTH} AS v, atan2(vy, vx) AS h FROM c), e AS (SELECT *, {_smooth('v', 5)} AS speed, h - lag(h) OVER (PARTITION BY track_id ORDER BY frame) AS st FROM d),
            f AS (SELECT *, first(h) OVER (PARTITION BY track_id ORDER BY frame) + sum(coalesce(st - {half} * round(st / {half}), 0)) OVER (PARTITION BY track_id ORDER BY frame) AS hd FROM e), g AS (SELECT *, ({_gradient('hd')}) * {rate} AS tn FROM f),
            i AS (SELECT *, least(greatest({_smooth('tn', 7)}, -{M.MOST_YAW}), {M.MOST_YAW}) AS yw, least(greatest(speed / {M.SURE_SPEED}, 0), 1) AS cf FROM g)
            SELECT episode_id, is_person, track_id, frame, CASE WHEN n <= 4 THEN 0 ELSE round(speed, 4) END AS speed, CASE WHEN n <= 4 THEN 0 ELSE round(yw * cf, 4) END AS yaw_rate, CASE WHEN n <= 4 THEN 0 ELSE round(cf, 4) END AS path_conf FROM i""",
        "detection_velocity": T + f" SELECT episode_id, is_person, track_id, frame, round(coalesce((cx - lag(cx) OVER w) * {rate}, 0), 4) AS vx, round(coalesce((cy - lag(cy) OVER w) * {rate}, 0), 4) AS vy FROM cen WINDOW w AS (PARTITION BY track_id ORDER BY frame)",
        "quat_continuity": """WITH q AS (SELECT vec_id, vec_id // 50 AS s, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 5)] AS e FROM embeddings), d AS (SELECT *, list_dot_product(e, lag(e) OVER (PARTITION BY s ORDER BY vec_id)) AS d FROM q),
            k AS (SELECT *, CASE WHEN count(*) FILTER (d < 0) OVER (PARTITION BY s ORDER BY vec_id) % 2 = 1 THEN -1 ELSE 1 END AS k FROM d) SELECT vec_id, round(k * e[1], 6) AS w, round(k * e[2], 6) AS x, round(k * e[3], 6) AS y, round(k * e[4], 6) AS z FROM k""",
        "object_tracks": T
        + f""", o AS (SELECT *, (x2 - x1) * (y2 - y1) AS ar, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)) AS d, row_number() OVER w AS a, count(*) OVER (PARTITION BY track_id) AS n FROM cen WHERE NOT is_person WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
            g AS (SELECT episode_id, track_id, min(frame) AS t_first, max(frame) AS t_last, any_value(label) AS label, avg(ar) FILTER (a > n - 3) / greatest(avg(ar) FILTER (a <= 3), 1e-9) AS r, coalesce(sum(d), 0) / 1000 AS len FROM o WHERE n >= {M.TRACK_ROWS} GROUP BY ALL),
            p AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY len DESC, track_id) AS place FROM g)
            SELECT episode_id, track_id, t_first, t_last, label, round(r, 4) AS size_change_ratio, round(len, 4) AS length, len > {M.MOVING} AS moving, CAST(place AS INTEGER) AS place FROM p WHERE place <= {M.TRACKS_SHOWN}""",
        "hit_summary": f"""WITH r AS (SELECT user_id, event_type, (epoch_us(ts) / 1e6 - 1704067200.0) / 86400 AS t, arg_max(value, event_id) / 400 AS conf FROM events GROUP BY user_id, event_type, ts), q AS (SELECT * FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click'), ('view'), ('unicorn')) x(event_type)),
            h AS (SELECT user_id, event_type, count(*) AS n, max(conf) AS m FROM r GROUP BY ALL), s AS (SELECT user_id, event_type, list_sort(list(DISTINCT CAST(floor(t) AS BIGINT)))[1:{M.SECONDS_SHOWN}] AS s FROM r WHERE conf >= {M.STRONG} GROUP BY ALL)
            SELECT user_id, event_type, coalesce(n, 0) AS n_hits, coalesce(round(m, 3), 0) AS max_conf, coalesce(array_to_string(s, ','), '') AS present_seconds, CASE WHEN s IS NOT NULL THEN 'present' WHEN n > 0 THEN 'weak_evidence' ELSE 'not_found' END AS verdict FROM q LEFT JOIN h USING (user_id, event_type) LEFT JOIN s USING (user_id, event_type)""",
        "violation_banner": "SELECT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + k AS frame, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events, range(4) r(k) WHERE event_type IN ('error', 'signup') GROUP BY ALL",
        "energy_envelope": "SELECT user_id, event_id, round(e, 5) AS energy FROM (SELECT user_id, event_id, sum(value * value) OVER w / 7 AS e, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE n = 7",
        "circuit_status": f"""WITH c AS (SELECT unnest({M.CIRCUIT}) AS stage, unnest(range({len(M.CIRCUIT)})) AS i),
            l AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'info' END WHEN event_type = 'view' THEN 'warn' ELSE 'info' END AS level, coalesce(CASE WHEN event_id % 17 = 0 THEN 'verifier' WHEN event_id % 19 = 0 THEN 'canvas' END, '') AS agent, ({messages})[event_id % {len(MESSAGES)} + 1] AS message FROM events WHERE event_id % 40 < 8),
            s AS (SELECT l.*, st.stage, c.i FROM (SELECT *, {stage} AS stage FROM l) st JOIN c USING (stage) JOIN l USING (user_id, event_id)),
            mk AS (SELECT user_id, stage, arg_max(level, event_id) FILTER (level <> 'info') AS mark FROM s GROUP BY ALL), fo AS (SELECT user_id, max(i) AS latest, arg_max(i, event_id) FILTER (level = 'error') AS f FROM s GROUP BY 1),
            b AS (SELECT u.user_id, ({statuses})[u.user_id % 5 + 1] AS status, coalesce(latest, 0) AS latest, f FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN fo USING (user_id)),
            d AS (SELECT user_id, status, CASE WHEN status IN ('completed', 'partial', 'failed') THEN 7 ELSE latest END AS latest, coalesce(f, CASE WHEN status = 'failed' THEN 7 END) AS f FROM b),
            e AS (SELECT d.*, c.stage, c.i, coalesce(mark = 'warn', false) OR (status = 'partial' AND c.stage = 'export') AS warns FROM d CROSS JOIN c LEFT JOIN mk ON mk.user_id = d.user_id AND mk.stage = c.stage)
            SELECT user_id, stage, CASE WHEN f IS NOT NULL THEN CASE WHEN i < f THEN 'done' WHEN i = f THEN 'failed' ELSE 'queued' END WHEN status = 'completed' THEN 'done' WHEN i <= latest THEN CASE WHEN warns THEN 'warning' WHEN i < latest OR status = 'partial' THEN 'done' ELSE 'running' END ELSE 'queued' END AS state FROM e""",
        "phase_history": "SELECT user_id, arg_max(event_type, event_id) AS phase, string_agg(event_type, ',' ORDER BY event_id) AS history, arg_max(value, event_id) FILTER (event_type = 'click') AS accepted, max(event_id) FILTER (event_id % 7 = 0) AS exported FROM events GROUP BY 1",
    }
