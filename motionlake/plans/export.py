"""Queries of wide episode exports and deliveries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import export as E
from ..operators import manipulation as M
from ..schemas import VERBS
from . import manipulation
from .gate import rounded

EPISODE = ["episode_id"]


def _frames(spark, sf_dir):
    return adapters.poses(spark, sf_dir).select("episode_id", "frame", "t")


def _export(spark, sf_dir):
    xyz = E.floats(F.col("px"), F.col("py"), F.col("pz")).alias("value")
    hands, objects = adapters.hands(spark, sf_dir).where("joint_name = 'wrist'"), adapters.objects(spark, sf_dir)
    joints = adapters.joints(spark, sf_dir).where("episode_id % 3 != 0").groupBy("episode_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("joint", "q"))), lambda x: x["q"].cast("float")).alias("value"))
    components = {"observation.camera": adapters.poses(spark, sf_dir).select("episode_id", "frame", xyz)}
    components |= {f"human.wrist.{h[0]}": hands.where(F.col("hand") == h).select("episode_id", "frame", xyz) for h in adapters.HANDS}
    components |= {f"object.{o}": objects.where(F.col("object_id") == o).select("episode_id", "frame", xyz) for o in adapters.OBJECTS}
    return E.episode_rows(_frames(spark, sf_dir), components | {"retarget.qpos": joints}, EPISODE), list(components) + ["retarget.qpos"]


def episode_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _export(spark, sf_dir)
    text = lambda n: F.array_join(F.transform(F.col(f"`{n}`"), lambda x: F.round(x.cast("double"), 3).cast("string")), ",").alias(n.replace(".", "_"))
    return rows.select("episode_id", "frame", *[text(n) for n in names])


def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _export(spark, sf_dir)
    meta = E.episode_meta(rows, adapters.hands(spark, sf_dir), EPISODE)
    found = meta.join(E.validate_export(rows, meta, _frames(spark, sf_dir), EPISODE), EPISODE)
    return rounded(found.withColumn("omitted", F.array_join("omitted", "; ")), 6, "duration_s", "pose_quality")


def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment and contacts of each frame."""
    frames, heights = manipulation._right_hand(spark, sf_dir)
    segments = M.subtask_segments(frames, heights, EPISODE, VERBS)
    own = _frames(spark, sf_dir)
    touched = M.touched(manipulation._contacts(spark, sf_dir), EPISODE).where("frame % 5 != 0")
    return E.subtask_index(own, segments, EPISODE).withColumn("subtask_index", F.col("subtask_index").cast("int")).join(E.contact_flags(own, touched, EPISODE), ["episode_id", "frame"])


def _variants(spark, sf_dir):
    """Orders as variants of their customer's job."""
    return adapters.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS job", "o_orderkey AS variant_id", "o_orderkey % 10 != 3 AS generated", "element_at(array('accept', 'review', 'reject', NULL), CAST(o_orderkey % 4 AS INT) + 1) AS verdict", "o_orderkey % 4 = 0 AND o_totalprice > 100000 AS accepted", "o_orderkey % 8 != 4 AS exported",
        "if(o_orderkey % 4 = 0, o_orderpriority, NULL) AS session", "if(o_orderkey % 3 = 0, array('blurred'), array('blurred', 'cut')) AS reasons",
    )


def delivery_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delivery_funnel(_variants(spark, sf_dir), "job")


def delivered_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.deliverable(_variants(spark, sf_dir))
    return rows.select("job", "variant_id").join(E.attached_labels(rows, ["job", "variant_id", "verdict"]), "variant_id")


def rejected_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rejections(_variants(spark, sf_dir), "job")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overview({"episodes": adapters.cameras(spark, sf_dir), "runs": adapters.table(spark, sf_dir, "orders"), "variants": _variants(spark, sf_dir).where("generated"), "labels": adapters.table(spark, sf_dir, "labels")})


NAMES = [episode_export, export_report, frame_labels, delivery_funnel, delivered_episodes, rejected_variants, overview]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


VARIANTS = """WITH v AS (SELECT o_custkey AS job, o_orderkey AS variant_id, o_orderkey % 10 <> 3 AS generated, (['accept', 'review', 'reject', NULL])[o_orderkey % 4 + 1] AS verdict, o_orderkey % 4 = 0 AND o_totalprice > 100000 AS accepted, o_orderkey % 8 <> 4 AS exported,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS session, CASE WHEN o_orderkey % 3 = 0 THEN '["blurred"]' ELSE '["blurred","cut"]' END AS reasons FROM orders)"""


def oracle_sql() -> dict[str, str]:
    three = lambda e, k, fit: f"CASE WHEN {fit} THEN {' || {c} || '.join(f'(round(CAST(CAST({e}[{k + i}] AS FLOAT) AS DOUBLE), 3) + 0)' for i in (1, 2, 3)).format(c=chr(39) + ',' + chr(39))} END"
    box = "NOT EXISTS (FROM em x WHERE x.episode_id = em.episode_id AND x.frame % 7 = 3)"
    steps = ["count(*)", "count(*) FILTER (generated)", "count(*) FILTER (verdict = 'accept')", "count(*) FILTER (verdict = 'review')", "count(*) FILTER (verdict = 'reject')", "count(*) FILTER (accepted)", "count(*) FILTER (accepted AND exported)", "count(DISTINCT session)"]
    names = ["requested (events x cams)", "generated", "verification: accept", "verification: review", "verification: reject", "pipeline accepted", "exported", "multi-view sessions"]
    qpos = "CASE WHEN episode_id % 3 <> 0 THEN (round(CAST(CAST(3 * e[35] AS FLOAT) AS DOUBLE), 3) + 0) || ',' || (round(CAST(CAST(3 * e[36] AS FLOAT) AS DOUBLE), 3) + 0) || ',' || (round(CAST(CAST(3 * e[37] AS FLOAT) AS DOUBLE), 3) + 0) END"
    return {
        "episode_export": manipulation.EPISODES
        + f""" SELECT episode_id, frame, {three('e', 31, 'true')} AS observation_camera, {three('e', 0, 'true')} AS human_wrist_l, {three('e', 9, 'true')} AS human_wrist_r, {three('e', 54, box)} AS object_box, {three('e', 46, 'true')} AS object_cup, {qpos} AS retarget_qpos FROM em""",
        "export_report": manipulation.EPISODES
        + """, q AS (SELECT episode_id, avg(conf) AS c FROM hands GROUP BY 1), n AS (SELECT episode_id, count(*) AS n, max(t) + 1 / 30.0 AS d, bool_or(frame % 7 = 3) AS gap FROM em GROUP BY 1)
            SELECT episode_id, n AS length, round(d, 6) AS duration_s, concat_ws('; ', CASE WHEN gap THEN 'object.box (frame mismatch)' END, CASE WHEN episode_id % 3 = 0 THEN 'retarget.qpos' END) AS omitted, round(c, 6) AS pose_quality, n AS rows, true AS passed FROM n JOIN q USING (episode_id)""",
        "frame_labels": manipulation.SEGMENTS.replace("SELECT episode_id, CAST(place AS INTEGER) AS place, round(min(start_s), 6) AS start_s, round(arg_max(end_s, (k, i)), 6) AS end_s, arg_min(skill, (k, i)) AS skill, arg_min(text, (k, i)) AS text FROM isles GROUP BY episode_id, place", "")
        .rstrip() + """, seg AS (SELECT episode_id, place, min(start_s) AS s, arg_max(end_s, (k, i)) AS e FROM isles GROUP BY episode_id, place)
            SELECT m.episode_id, m.frame, CAST(coalesce((SELECT max(place) FROM seg WHERE seg.episode_id = m.episode_id AND m.t BETWEEN s AND e), -1) AS INTEGER) AS subtask_index, m.frame % 5 <> 0 AND coalesce((SELECT bool_or(contact) FROM touched c WHERE c.episode_id = m.episode_id AND c.frame = m.frame AND hand = 'left'), false) AS contact_l,
              m.frame % 5 <> 0 AND coalesce((SELECT bool_or(contact) FROM touched c WHERE c.episode_id = m.episode_id AND c.frame = m.frame AND hand = 'right'), false) AS contact_r FROM em m""",
        "delivery_funnel": VARIANTS + f", s AS (SELECT job, {', '.join(f'{c} AS s{i}' for i, c in enumerate(steps))} FROM v GROUP BY 1) " + " UNION ALL ".join(f"SELECT job, {i} AS place, '{n}' AS step, s{i} AS n FROM s" for i, n in enumerate(names)),
        "delivered_episodes": VARIANTS + """ SELECT job, variant_id, '{"job":' || job || ',"variant_id":' || variant_id || ',"verdict":"accept"}' AS payload FROM v WHERE accepted AND exported""",
        "rejected_variants": VARIANTS + """ SELECT job, '[' || string_agg('{"variant_id":' || variant_id || ',"verdict":"' || verdict || '","reasons":' || reasons || '}', ',' ORDER BY verdict = 'review', variant_id) || ']' AS rejected FROM v WHERE verdict IN ('reject', 'review') GROUP BY 1""",
        "overview": "SELECT (SELECT count(DISTINCT vec_id // 50) FROM embeddings) AS episodes, (SELECT count(*) FROM orders) AS runs, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 3) AS variants, (SELECT count(*) FROM labels) AS labels",
    }
