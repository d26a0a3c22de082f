"""Queries of streams, over the whole table; tests run the same functions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..sources import shared
from ..streaming import logs, trackers


def _events(spark, sf_dir):
    return adapters.table(spark, sf_dir, "events")


def text_time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tumbling_counts(_events(spark, sf_dir), "6 hours", "event_type").select(text_time("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sliding_average(_events(spark, sf_dir), "1 day", "6 hours", "event_type").select(text_time("start"), "event_type", F.round("mean", 6).alias("mean"), "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.session_windows(_events(spark, sf_dir), "2 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return logs.without_repeats(rows.select("ts", "user_id", "event_type", "hour"), "user_id", "event_type", "hour").select("user_id", "event_type", "hour")


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), F.concat(F.lit("Agent"), F.col("user_id") % 4).alias("agent"), "props", F.col("props").alias("message"), F.lit(None).cast("string").alias("batch_id"), F.lit("job").alias("job_id"))
    return logs.matching(logs.since(log, 500), level="error", text="AGENT2 ERROR").select("id")


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in logs.STATES]), (F.get_json_object("props", "$.k").cast("int") % 7) + 1)
    return logs.furthest_state(_events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts", state.alias("state")))


def approx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each kind of event by a sketch (an extra; compared within its error in the tests)."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def _detections(events: DataFrame) -> DataFrame:
    return events.select("user_id", "ts", F.col("event_id").alias("frame"), F.col("value").alias("x"), (4.0 * adapters.props_k()).alias("y"))


def _tracked(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "kind", "frame", *[F.round(c, 4).alias(c) for c in ("vx", "vy")], "n")


def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(trackers.track_rows(_detections(_events(spark, sf_dir)), ["user_id"], adapters.FPS))


def tracker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table read as a stream to its end, with keyed state; the same rows as ``tracker_rows``."""
    # A stream's path is a folder or a pattern; the table may be one file.
    events = spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")
    return _tracked(trackers.run_to_end(trackers.track_stream(_detections(events), ["user_id"], adapters.FPS, "0 seconds"), shared.new_folder(spark, "trackers")))


def numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.numbered(_events(spark, sf_dir).select("ts", "event_id", "event_type"), ["ts", "event_id"], 1).select("id", "event_id", "event_type")


NAMES = [tumbling_counts, sliding_average, session_windows, dedup_stream, log_search, job_state, tracker_rows, tracker_stream, numbered_log, approx_users]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


#: A track ends after six hours without an event; rows at the last millisecond wait for the watermark.
TRACKS_SQL = f"""WITH e AS (SELECT user_id, event_id AS frame, epoch_ms(ts) AS ms, value AS x, 4.0 * CAST(json_extract_string(props, '$.k') AS INTEGER) AS y, max(epoch_ms(ts)) OVER () AS now FROM events),
    s AS (SELECT *, coalesce(ms - lag(ms) OVER w > {trackers.GAP_MS}, true) AS new, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(ms) OVER w AS nxt FROM e WHERE ms < now WINDOW w AS (PARTITION BY user_id ORDER BY ms, frame)),
    p AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ms, frame) AS part FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY ms, frame) AS n FROM p)
    SELECT user_id, 'seen' AS kind, frame, round(CASE WHEN new THEN 0 ELSE dx * {adapters.FPS} END, 4) AS vx, round(CASE WHEN new THEN 0 ELSE dy * {adapters.FPS} END, 4) AS vy, n FROM n
    UNION ALL SELECT user_id, 'ended', frame, NULL, NULL, n FROM n WHERE coalesce(nxt - ms > {trackers.GAP_MS}, ms + {trackers.GAP_MS} < now)"""


def oracle_sql() -> dict[str, str]:
    return {
        "numbered_log": "SELECT row_number() OVER (ORDER BY ts, event_id) AS id, event_id, event_type FROM events",
        "tracker_rows": TRACKS_SQL,
        "tracker_stream": TRACKS_SQL,
        "tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "sliding_average": """WITH e AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts) - (unnest(range(4)) * INTERVAL 6 HOUR) AS s FROM events)
            SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY ALL""",
        "session_windows": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
            SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
        "dedup_stream": "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour FROM events",
        "log_search": "SELECT event_id AS id FROM events WHERE event_id > 500 AND event_type = 'error' AND user_id % 4 = 2",
        "job_state": """WITH e AS (SELECT user_id AS job_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS p FROM events)
            SELECT job_id, (['queued', 'generating', 'reviewing', 'labeling', 'rendering', 'completed', 'failed'])[arg_max(p, (ts, p)) + 1] AS state, max(p) AS furthest, count(*) AS changes FROM e GROUP BY 1""",
    }
