"""Queries of sessions of cameras. A session is ten users, a camera a kind of event, its sound the values of each six hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import sessions as S

KEY, PER_DAY = ["session_id"], 4
ROOMY = 1e9


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0) * PER_DAY / 86400)
    rows = adapters.table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).cast("long").alias("session_id"), F.col("event_type").alias("name"), slot.alias("i"), "value")
    return rows.groupBy("session_id", "name", "i").agg(F.sum("value").alias("v"))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _signals(spark, sf_dir)
    names = signals.select("session_id", "name").distinct()
    pairs = names.withColumnRenamed("name", "a").join(names.withColumnRenamed("name", "b"), "session_id").where("a < b")
    return S.offsets(signals, pairs, KEY, PER_DAY, size=64)


def camera_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("session_id", "a", "b", "offset_s", F.round("confidence", 6).alias("confidence"))


def session_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offsets of a session count alike."""
    cameras, _ = S.clocks(_offsets(spark, sf_dir).withColumn("weight", F.lit(1.0)), KEY, ROOMY)
    return cameras.withColumn("offset_s", F.round("offset_s", 6))


def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets that the others of their session don't agree with."""
    _, links = S.clocks(_offsets(spark, sf_dir).withColumnRenamed("confidence", "weight"), KEY, 1.0)
    return links.select("session_id", "a", "b", F.round("residual_s", 6).alias("residual_s"), "broken")


def camera_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of a customer are the priorities of its orders; lines of an order are takes, those returned can't be probed. Lines
    may repeat an order's number; the table's last one counts, as in one thread's run of the SQL."""
    orders = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("camera"), "o_orderkey")
    size = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int") * 20)
    lines = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), size.alias("width"), size.alias("height"), "_metadata.file_name", "_metadata.row_index")
    customers = adapters.table(spark, sf_dir, "customer").where("c_custkey % 5 != 0")
    priors = orders.select("session_id", "camera").distinct().join(customers, F.col("session_id") == F.col("c_custkey"))
    priors = priors.select("session_id", "camera", (F.col("c_nationkey") * 14.0).alias("azimuth_deg"), (1 + F.col("c_nationkey") / 20.0).alias("height_m"), F.lit(4.0).alias("distance_m"), (F.col("c_custkey") % 140).cast("double").alias("fov_deg"))
    found = S.camera_priors(orders.select("session_id", "camera").distinct(), priors, lines.join(orders, "o_orderkey"), KEY, ["file_name", "row_index"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f", F.round(x, 3) + F.lit(0.0))), ",").alias(c)
    return found.select("session_id", "camera", "width", "height", F.round("fx", 4).alias("fx"), text("r"), text("t"))


NAMES = [camera_offsets, session_clocks, session_links, camera_priors]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


OFFSETS_SQL = f"""WITH s AS (SELECT user_id // 10 AS session_id, event_type AS name, CAST(floor((epoch_us(ts) / 1e6 - 1704067200.0) * {PER_DAY} / 86400) AS BIGINT) AS i, sum(value) AS v FROM events GROUP BY ALL),
k AS (SELECT session_id, name, max(i) + 1 AS n, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL),
c AS (SELECT session_id, a.name AS a, b.name AS b, a.i - b.i AS lag, sum(a.v * b.v) AS value FROM s a JOIN s b USING (session_id) WHERE a.name < b.name GROUP BY ALL),
p AS (SELECT c.*, ka.n AS na, ka.norm * kb.norm AS norm, max(value) OVER (PARTITION BY c.session_id, a, b) AS peak FROM c JOIN k ka ON ka.session_id = c.session_id AND ka.name = a JOIN k kb ON kb.session_id = c.session_id AND kb.name = b),
o AS (SELECT session_id, a, b, CASE WHEN max(na) > {S.FEW} THEN min(lag) / {float(PER_DAY)} ELSE 0 END AS offset_s, CASE WHEN max(na) > {S.FEW} THEN least(greatest(max(peak) / (max(norm) + 1e-6), 0), 1) ELSE {S.UNSURE} END AS confidence FROM p WHERE value >= peak - {S.SAME} * norm GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    unit = lambda v: [f"({c}) / (sqrt({' + '.join(f'({x}) * ({x})' for x in v)}) + 1e-8)" for c in v]
    forward = unit(["0 - ex", "0 - ey", "0.9 - ez"])
    right = unit(["fy", "-fx_", "0"])
    return {
        "camera_offsets": OFFSETS_SQL + " SELECT session_id, a, b, offset_s, round(confidence, 6) AS confidence FROM o",
        "session_clocks": OFFSETS_SQL
        + """, d AS (SELECT session_id, b AS camera, offset_s AS x FROM o UNION ALL SELECT session_id, a, -offset_s FROM o),
            x AS (SELECT session_id, camera, sum(x) / (count(*) + 1) AS x FROM d GROUP BY ALL)
            SELECT session_id, camera, min(camera) OVER w AS reference, round(x - first(x) OVER (PARTITION BY session_id ORDER BY camera), 6) AS offset_s FROM x WINDOW w AS (PARTITION BY session_id)""",
        "camera_priors": f"""WITH c AS (SELECT DISTINCT o_custkey AS session_id, o_orderpriority AS camera FROM orders),
            t AS (SELECT o_custkey AS session_id, o_orderpriority AS camera, arg_min(CAST(l_quantity AS INTEGER) * 20, l_orderkey * 10 + l_linenumber) AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND CAST(l_quantity AS INTEGER) > 0 GROUP BY ALL),
            q AS (SELECT c.*, coalesce(size, {S.DEFAULT_PROBE['width']}) AS width, coalesce(size, {S.DEFAULT_PROBE['height']}) AS height, radians(coalesce(c_nationkey * 14.0, 0)) AS az, CAST(coalesce(1 + c_nationkey / 20.0, 1.5) AS DOUBLE) AS ez, CASE WHEN c_custkey IS NULL THEN 3.0 ELSE 4.0 END AS dist, greatest(least(coalesce(c_custkey % 140, 60), 120), 20) AS fov
                FROM c LEFT JOIN t USING (session_id, camera) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = session_id),
            e AS (SELECT *, dist * sin(az) AS ex, dist * cos(az) AS ey FROM q), f AS (SELECT *, {forward[0]} AS fx_, {forward[1]} AS fy, {forward[2]} AS fz FROM e), g AS (SELECT *, {right[0]} AS rx, {right[1]} AS ry, {right[2]} AS rz FROM f),
            h AS (SELECT *, -(ry * fz - rz * fy) AS dx, -(rz * fx_ - rx * fz) AS dy, -(rx * fy - ry * fx_) AS dz FROM g)
            SELECT session_id, camera, width, height, round(width / (2 * tan(radians(fov) / 2)), 4) AS fx,
                array_to_string([printf('%.3f', round(v, 3) + 0.0) FOR v IN [rx, dx, fx_, ry, dy, fy, rz, dz, fz]], ',') AS r, array_to_string([printf('%.3f', round(v, 3) + 0.0) FOR v IN [ex, ey, ez]], ',') AS t FROM h""",
    }
