"""Queries of stages, hashes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import kinematics as K
from ..operators import lineage as L
from ..schemas import STAGES
from .gate import TRACKS_SQL

KINDS = ["click", "error", "purchase", "signup", "view"]
PLACES = {s: i for i, s in enumerate(STAGES)}


def stage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.closure(L.stage_edges(spark))


def skip_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = adapters.manifests(spark, sf_dir)
    now = before.withColumn("input_key", F.when(F.col("input_key") % 3 == 0, F.col("input_key") + 1).otherwise(F.col("input_key")))
    return L.may_skip(now, before, ["episode_id", "stage"]).select("episode_id", "stage", "skip")


def output_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.table(spark, sf_dir, "lineitem")
    files = items.select("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber")).alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    return L.output_hash(files, ["l_orderkey"], "path", "digest")


def input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.manifests(spark, sf_dir).withColumn("output_hash", F.sha2(F.col("input_key").cast("string"), 256))
    return L.input_hash(m, L.stage_edges(spark), F.lit("v1"))


def halted_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.create_map(*[x for s, i in PLACES.items() for x in (F.lit(s), F.lit(i))])
    return L.halted(adapters.manifests(spark, sf_dir), F.element_at(place, F.col("stage"))).select("episode_id", "stage", "status", "halted")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    base, new = orders.where("id % 3 != 0"), orders.where("id % 2 = 0").withColumn("status", F.lit("new"))
    return L.insert_if_absent(base, new, "id")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.table(spark, sf_dir, "customer").select("c_custkey")
    nations = adapters.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return L.round_robin(jobs.where("c_custkey > 0"), "c_custkey", nations, "n_nationkey", 25).select("c_custkey", "n_name")


def event_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.variants(adapters.table(spark, sf_dir, "nation").select("n_name"), "n_name", ["front", "left", "top"])


def dataset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.runs(spark, sf_dir).select("id", F.concat(F.lit("clip_"), F.col("batch") % 50).alias("name"), "status")
    return L.unique_names(runs, "name", "id").select("id", "file")


def training_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    found = L.wide(events, ["user_id"], "event_type", KINDS, "value", 0.0)
    return found.select("user_id", *[F.round(k, 6).alias(k) for k in KINDS])


def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a track and frame with the camera's motion and the number of events, null where there is none."""
    tracks = adapters.tracks(spark, sf_dir)
    cam = K.camera_motion(K.consecutive(tracks)).select("episode_id", "frame", "cam_x")
    kinds = adapters.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id"), F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long").alias("frame")).agg(F.count_distinct("event_type").alias("kinds"))
    return tracks.select(*K.TRACK, "frame", "label").join(cam, ["episode_id", "frame"], "left").join(kinds, ["track_id", "frame"], "left").withColumn("cam_x", F.round("cam_x", 4))


def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events")
    side = lambda kind: events.where(F.col("event_type") == kind).select("user_id", "event_id")
    return L.positional(side("click"), side("view"), ["user_id"], "event_id")


NAMES = [stage_closure, skip_decision, output_hash, input_hash, halted_stages, insert_if_absent, round_robin, event_variants, dataset_index, training_pivot, wide_export, positional_pairs]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


MAN = f"WITH m AS (SELECT l_orderkey AS episode_id, ({adapters.LINE_STAGES})[l_linenumber] AS stage, min(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'success' END) AS status, max(l_partkey) AS input_key FROM lineitem GROUP BY ALL)"


def oracle_sql() -> dict[str, str]:
    edges = "edges(stage, dep) AS (VALUES " + ", ".join(f"('{s}', '{d}')" for s, deps in STAGES.items() for d in deps) + ")"
    place = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for s, i in PLACES.items()) + " END"
    return {
        "stage_closure": f"WITH RECURSIVE {edges}, need(stage, dep) AS (SELECT stage, dep FROM edges UNION SELECT n.stage, e.dep FROM need n JOIN edges e ON e.stage = n.dep) SELECT stage, dep FROM need",
        "skip_decision": MAN + " SELECT episode_id, stage, status = 'success' AND input_key % 3 <> 0 AS skip FROM m",
        "output_hash": "SELECT l_orderkey, sha256(string_agg('f' || l_linenumber || '=' || sha256(CAST(l_partkey AS VARCHAR)), chr(10) ORDER BY 'f' || l_linenumber || '=' || sha256(CAST(l_partkey AS VARCHAR)))) AS output_hash, count(*) AS n_files FROM lineitem GROUP BY 1",
        "input_hash": MAN + f", {edges} SELECT episode_id, e.stage, sha256(string_agg(dep || '=' || sha256(CAST(input_key AS VARCHAR)), '|' ORDER BY dep) || '|v1') AS input_hash FROM m JOIN edges e ON e.dep = m.stage GROUP BY ALL",
        "halted_stages": MAN + f" SELECT episode_id, stage, status, coalesce(max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY {place} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND stage NOT IN ('qa', 'package') AS halted FROM m",
        "insert_if_absent": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'new' END AS status FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
        "round_robin": "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = (c_custkey - 1) % 25 WHERE c_custkey > 0",
        "event_variants": "SELECT n_name, camera, n_name || '_' || camera AS variant_id FROM nation, (SELECT unnest(['front', 'left', 'top']) AS camera)",
        "dataset_index": "WITH r AS (SELECT o_orderkey AS id, 'clip_' || (o_custkey % 50) AS name FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM r) SELECT id, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS file FROM k",
        "training_pivot": "SELECT user_id, " + ", ".join(f"round(coalesce(avg(value) FILTER (event_type = '{k}'), 0), 6) AS {k}" for k in KINDS) + " FROM events GROUP BY 1",
        "wide_export": "WITH " + TRACKS_SQL + " kinds AS (SELECT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frame, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL) SELECT t.episode_id, is_person, t.track_id, t.frame, label, round(cam_x, 4) AS cam_x, kinds FROM tracks t LEFT JOIN cam c ON c.episode_id = t.episode_id AND c.frame = t.frame LEFT JOIN kinds k ON k.user_id = t.track_id AND k.frame = t.frame",
        "positional_pairs": "WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM events) SELECT a.user_id, CAST(a.place AS INTEGER) AS place, a.event_id, b.event_id AS event_id_2 FROM e a JOIN e b ON a.user_id = b.user_id AND a.place = b.place AND a.event_type = 'click' AND b.event_type = 'view'",
    }
