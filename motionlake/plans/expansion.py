"""Queries of expanded jobs and of files that tell of changes; jobs are parts, files the pages of a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import expansion as X

EVENTS, HOSTS, SMALL = 3, 50, 2_000
FOLDERS = ["a/0", "a/1", "a/2", "b", "c/2/deep", "nowhere"]


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return adapters.table(spark, sf_dir, "part").select(k.alias("job"), F.col("p_name").alias("prompt"), F.when(k % 2 == 0, k).alias("seed"), (k % 6).alias("cameras"))


def expanded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.expanded_events(_jobs(spark, sf_dir), EVENTS)


def expanded_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.expanded_cameras(_jobs(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, html = F.col("page_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    folder = F.when(k % 4 == 0, F.concat(F.lit("a/"), k % 3)).when(k % 4 == 1, F.lit("b")).when(k % 4 == 2, F.concat(F.lit("c/"), k % 3, F.lit("/deep")))
    return adapters.table(spark, sf_dir, "pages").select((k % HOSTS).alias("host"), F.concat_ws("/", folder, F.concat(k, F.lit(".html"))).alias("path"), F.octet_length(html).alias("size"), html.alias("content"))


def output_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    declared = files.select("host").distinct().select("host", F.explode(F.array(*[F.lit(o) for o in ("a", "a/1", "c", "gone.txt")])).alias("output"))
    return X.output_hashes(declared, files, "host", SMALL)


def missing_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.missing_folders(_files(spark, sf_dir), "host", FOLDERS).withColumn("missing", F.array_join("missing", ","))


NAMES = [expanded_events, expanded_cameras, output_hashes, missing_folders]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


FILES = f"""WITH f AS (SELECT page_id % {HOSTS} AS host, coalesce(CASE page_id % 4 WHEN 0 THEN 'a/' || page_id % 3 WHEN 1 THEN 'b' WHEN 2 THEN 'c/' || page_id % 3 || '/deep' END || '/', '') || page_id || '.html' AS path,
  octet_length(encode(coalesce(html, ''))) AS size, CASE WHEN octet_length(encode(coalesce(html, ''))) < {SMALL} THEN sha256(coalesce(html, '')) ELSE 'size:' || octet_length(encode(coalesce(html, ''))) END AS token FROM pages)"""


def oracle_sql() -> dict[str, str]:
    draw = lambda values, what: f"({values})[CAST(('0x' || left(sha256(coalesce(CAST(seed AS VARCHAR), prompt) || ':' || i || ':{what}'), 12)) AS BIGINT) % {len(values)} + 1]"
    jobs = "j AS (SELECT p_partkey AS job, p_name AS prompt, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS seed, p_partkey % 6 AS n FROM part)"
    return {
        "expanded_events": f"""WITH {jobs}, e AS (SELECT job, prompt, i, {draw(X.TIMES_OF_DAY, 'time')} AS time_of_day, {draw(X.MOTION_STYLES, 'style')} AS motion_style FROM j, range({EVENTS}) r(i))
            SELECT job, printf('e%02d', i) AS event_id, motion_style, time_of_day, CASE WHEN contains(time_of_day, 'night') THEN '{X.NIGHT_LIGHT}' ELSE '{X.DAY_LIGHT}' END AS lighting,
                'A person: ' || prompt || '. The motion is ' || motion_style || ', realistic human biomechanics, subject fully visible' AS base_prompt FROM e""",
        "expanded_cameras": f"""WITH {jobs}, c AS (SELECT job, i, CAST(i * 360.0 / n AS DOUBLE) AS az, CAST(1.0 + 0.6 * (i % 3) AS DOUBLE) AS h, CAST(2.5 + 0.8 * i AS DOUBLE) AS d, CAST(60.0 + 5.0 * (i % 3) AS DOUBLE) AS f FROM j, range(6) r(i) WHERE i < n)
            SELECT job, 'cam' || i AS cam_id, az AS azimuth_deg, h AS height_m, d AS distance_m, f AS fov_deg, printf('Shot from a static camera at %.1fm height, %.1fm away, %.0f degrees around the subject', h, d, az) AS description FROM c""",
        "output_hashes": FILES
        + """, d AS (SELECT host, o FROM (SELECT DISTINCT host FROM f), (VALUES ('a'), ('a/1'), ('c'), ('gone.txt')) v(o)),
            e AS (SELECT d.host, coalesce(path, o) AS path, coalesce(size, -1) AS size, coalesce(token, 'missing') AS token FROM d LEFT JOIN f ON f.host = d.host AND (path = o OR starts_with(path, o || '/')))
            SELECT host, count(*) AS entries, sha256('[' || string_agg('["' || path || '", ' || size || ', "' || token || '"]', ', ' ORDER BY path, size, token) || ']') AS output_hash FROM e GROUP BY 1""",
        "missing_folders": FILES
        + f""", x AS (SELECT host, e, i FROM (SELECT DISTINCT host FROM f), (SELECT unnest({FOLDERS}) AS e, unnest(range({len(FOLDERS)})) AS i))
            SELECT x.host, coalesce(string_agg(e, ',' ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE f.host = x.host AND starts_with(f.path, e || '/'))), '') AS missing FROM x GROUP BY 1""",
    }
