"""Queries of scenarios, contracts and run lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import contracts as C
from .gate import TRACKS_SQL
from .reports import RUNS_SQL


def _contracts(spark, sf_dir):
    """Suppliers as worlds."""
    return adapters.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS world",
        "concat('world_', s_suppkey) AS world_id",
        "array(named_struct('id', if(s_suppkey % 7 = 0, 'arm', 'robot_arm'), 'type', if(s_suppkey % 7 = 0, 'arm', 'mobile_robot')), named_struct('id', 'box', 'type', 'storage_box'), named_struct('id', 'worker', 'type', 'person')) AS entities",
        "if(s_suppkey % 5 = 0, array('box'), array('box', if(s_suppkey % 7 = 0, 'arm', 'robot_arm'), 'worker')) AS registry",
        "if(s_suppkey % 6 = 0, '', 'hall') AS scene_id",
        "if(s_suppkey % 4 = 0, array(), array('same box')) AS identity_checks",
        "array('overhead_view', 'front_view') AS camera_angles",
        "array('slip', 'collision') AS event_types",
        "if(s_suppkey % 3 = 0, NULL, array(1D, 4D)) AS timing",
        "array(named_struct('entity_id', 'box', 'dx', array(0.5D, -0.5D), 'dy', CAST(NULL AS array<double>))) AS deltas",
        "array('new people') AS forbidden",
    )


def _scenarios(spark, sf_dir):
    """Lines of orders as scenarios of their supplier's world."""
    lines = adapters.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("world"), F.min("l_partkey").alias("p"), F.min(F.col("l_quantity").cast("int")).alias("q"))
    return lines.selectExpr(
        "world", "l_orderkey * 10 + l_linenumber AS line",
        "if(p % 13 = 0, ' ', concat('sc_', p % 9)) AS scenario_id",
        "concat('scene ', p) AS title",
        "CASE p % 4 WHEN 1 THEN array('robot_arm', 'box') WHEN 2 THEN array('robot_arm', 'box', 'worker', 'ghost') ELSE array('worker', 'robot_arm', 'box') END AS referenced",
        "element_at(array('overhead_view', 'front_view', 'close_up'), CAST(p % 3 AS INT) + 1) AS angle",
        "if(p % 17 = 0, 0D, 5D) AS duration",
        "element_at(array('slip', 'collision', 'fire'), q % 3 + 1) AS event_type",
        "'the box slips' AS description",
        "element_at(array('low', 'high', 'extreme'), q % 3 + 1) AS severity",
        "CAST(q % 7 AS DOUBLE) AS trigger",
        "CASE WHEN p % 6 = 5 THEN array() ELSE array(named_struct('entity_id', element_at(array('box', 'worker', 'table'), CAST(p % 3 AS INT) + 1), 'dx', (p % 5) / 4D - 0.25D, 'dy', if(p % 2 = 0, 0D, 0.1D))) END AS position_deltas",
        """CASE WHEN p % 11 = 0 THEN array() ELSE array(named_struct('actor', 'worker', 'action', 'drops_the box', 't_start', if(p % 8 = 0, 3D, 0D), 't_end', 2D),
          named_struct('actor', if(p % 10 = 0, 'ghost', 'robot_arm'), 'action', element_at(array('sings', 'stops_and waits', 'safely put down'), CAST(p % 3 AS INT) + 1), 't_start', 2.5D, 't_end', if(p % 9 = 0, 6D, 4.5D))) END AS timeline""",
        "if(p % 12 = 0, '', 'comes to rest-safely') AS response",
        "if(p % 5 = 0, array(), array('slip')) AS labels",
    )


def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).select("world", F.array_join(C.contract_errors(), "; ").alias("errors"))


def scenario_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate(_scenarios(spark, sf_dir), _contracts(spark, sf_dir), "world", "line").select("world", "line", F.array_join("errors", "; ").alias("errors"))


def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of fixes: five good scenarios for each world."""
    scenarios, contracts = _scenarios(spark, sf_dir), _contracts(spark, sf_dir)
    fixes = contracts.select("world", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("line")).selectExpr(
        "world", "CAST(line AS BIGINT) AS line", "concat('fix_', line) AS scenario_id", "'fixed' AS title", "array('worker', 'robot_arm', 'box') AS referenced", "'overhead_view' AS angle", "5D AS duration", "'slip' AS event_type", "'a slip' AS description", "'low' AS severity", "2D AS trigger",
        f"CAST(array() AS array<{C.DELTA}>) AS position_deltas", "array(named_struct('actor', 'robot_arm', 'action', 'halts', 't_start', 2D, 't_end', 3D)) AS timeline", "'halts' AS response", "array('slip') AS labels",
    )
    done = C.repaired(scenarios, contracts, [fixes], "world", "line")
    return done.groupBy("world").agg(F.count("*").alias("n"), F.count_if(F.col("title") == "fixed").alias("n_fixed"), F.sum(F.when(F.col("title") == "fixed", F.col("line"))).alias("fixed_lines"))


def verifier_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scenarios(spark, sf_dir).where(F.size("timeline") > 0).join(_contracts(spark, sf_dir), "world")
    k, p = C.keyframes(), C.verifier_packet()
    return rows.select("line", k.alias("k"), p.alias("p")).select(
        "line", F.array_join(F.transform("k", lambda x: F.concat(x["time"].cast("string"), F.lit("="), x["state"])), " | ").alias("keyframes"), "p.scenario_prompt", F.array_join("p.expected_objects", ",").alias("expected_objects"), "p.expected_action", "p.expected_outcome",
        F.col("p.consistency_policy.locked_scene_id").alias("locked_scene_id"), F.array_join("p.consistency_policy.locked_entity_ids", ",").alias("locked_entity_ids"),
    )


def scenario_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = adapters.tracks(spark, sf_dir).select("episode_id", "label", "is_person").distinct()
    expected = tracks.select("episode_id").distinct().select("episode_id", F.explode(F.array(F.lit("Human"), F.lit("object_1"), F.lit("small object_3"), F.concat(F.lit("Tool_"), F.col("episode_id") % 3))).alias("name"))
    found = C.scenario_check(expected, tracks, "episode_id")
    return found.select("episode_id", *[F.array_join(c, ",").alias(c) for c in ("detected", "expected", "missing")])


def run_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and quarantined runs."""
    return adapters.runs(spark, sf_dir).select("id", F.when(C.accepted(), "accepted").otherwise("quarantined").alias("list"))


def not_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("zones") % 4 == 0, "accept").when(F.col("zones") % 4 == 1, "reject").when(F.col("zones") % 4 == 2, "review")
    reasons = F.when(F.col("batch") % 2 == 0, F.array(F.lit("blurred"), F.lit("cut"))).otherwise(F.array().cast("array<string>"))
    return C.not_accepted(adapters.runs(spark, sf_dir).select("id", verdict.alias("verdict"), reasons.alias("reasons")), "verdict", "reasons").select("id", "verdict", "why")


def clamped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_custkey") % 9 == 0, "many").otherwise((F.col("o_totalprice") / 10000).cast("string"))
    return adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.clamped(text, 1, 40).alias("n"))


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.runs(spark, sf_dir).select("batch", "id", F.when(F.col("status") == "failed", F.concat(F.lit("run "), "id")).alias("error"), F.when(F.col("label_status") == "failed", F.concat(F.lit("label "), "id")).alias("label_error"), F.lit(None).cast("string").alias("render_error"))
    return C.first_error(jobs, "batch", "id", F.when(F.col("batch") % 2 == 0, F.lit("batch error")))


def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.element_at(F.array(F.lit("a"), F.lit(".."), F.lit(""), F.lit("b..c")), (F.col("p_partkey") % 4).cast("int") + 1), F.regexp_replace("p_name", " ", "/"), F.when(F.col("p_partkey") % 6 == 0, F.lit("..")))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", C.safe_path(path).alias("safe"))


NAMES = [contract_errors, scenario_errors, repair_rounds, verifier_packets, scenario_check, run_lists, not_accepted, clamped_counts, first_errors, safe_paths]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


ARM = "CASE WHEN s_suppkey % 7 = 0 THEN 'arm' ELSE 'robot_arm' END"
WORLDS = f"""WITH co AS (SELECT s_suppkey AS world, {ARM} AS arm, s_suppkey % 7 <> 0 AS robot, s_suppkey % 3 <> 0 AS timed, s_suppkey % 6 <> 0 AS scene FROM supplier),
li AS (SELECT l_orderkey * 10 + l_linenumber AS line, min(l_suppkey) AS world, min(l_partkey) AS p, min(CAST(trunc(l_quantity) AS INTEGER)) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
sc AS (SELECT line, co.*, p, q, CASE WHEN p % 13 = 0 THEN ' ' ELSE 'sc_' || (p % 9) END AS scenario_id,
  CASE p % 4 WHEN 1 THEN ['robot_arm', 'box'] WHEN 2 THEN ['robot_arm', 'box', 'worker', 'ghost'] ELSE ['worker', 'robot_arm', 'box'] END AS refs, [arm, 'box', 'worker'] AS locked, CASE WHEN p % 17 = 0 THEN 0 ELSE 5 END AS duration, q % 7 AS trig,
  p % 11 <> 0 AS acts, CASE WHEN p % 8 = 0 THEN 3 ELSE 0 END AS s0, CASE WHEN p % 10 = 0 THEN 'ghost' ELSE 'robot_arm' END AS actor, CASE WHEN p % 9 = 0 THEN 6 ELSE 4.5 END AS e1,
  (['sings', 'stops and waits', 'safely put down'])[p % 3 + 1] AS act, CASE WHEN p % 12 = 0 THEN '' ELSE 'comes to rest-safely' END AS resp, (['box', 'worker', 'table'])[p % 3 + 1] AS mover, (p % 5) / 4.0 - 0.25 AS dx, CASE WHEN p % 2 = 0 THEN 0 ELSE 0.1 END AS dy FROM li JOIN co USING (world)),
er AS (SELECT *, p % 6 <> 5 AS moves, [x FOR x IN locked IF NOT list_contains(refs, x)] AS missing, [x FOR x IN refs IF NOT list_contains(locked, x)] AS unknown,
  acts AND robot AND actor = 'robot_arm' AND 2.5 + 1e-6 >= trig AND (p % 3 = 1 OR (p % 3 = 2 AND resp <> '')) AS responds FROM sc),
told AS (SELECT *, concat_ws('; ',
  CASE WHEN len(missing) > 0 THEN 'referenced_entities is missing ' || array_to_string(list_sort(missing), ', ') END, CASE WHEN len(unknown) > 0 THEN 'referenced_entities has unknown ids ' || array_to_string(list_sort(unknown), ', ') END,
  CASE WHEN p % 3 = 2 THEN 'camera.angle is not allowed' END, CASE WHEN duration <= 0 THEN 'camera.duration_seconds must be positive' END, CASE WHEN q % 3 = 2 THEN 'event.type is not allowed' END, CASE WHEN q % 3 = 2 THEN 'event.risk_severity is unknown' END,
  CASE WHEN trig > duration THEN 'event.trigger_time_seconds is outside the clip' END, CASE WHEN timed AND trig NOT BETWEEN 1 AND 4 THEN 'event.trigger_time_seconds is outside the allowed window' END,
  CASE WHEN moves AND mover = 'table' THEN 'position_deltas[0]: not a locked entity' END, CASE WHEN moves AND mover = 'worker' AND (abs(dx) > 1e-9 OR abs(dy) > 1e-9) THEN 'position_deltas[0]: may not move' END,
  CASE WHEN moves AND mover = 'box' AND dx NOT BETWEEN -0.5 AND 0.5 THEN 'position_deltas[0]: dx is out of bounds' END, CASE WHEN moves AND mover = 'box' AND abs(dy) > 1e-9 THEN 'position_deltas[0]: dy is out of bounds' END,
  CASE WHEN NOT acts THEN 'action_timeline is empty' END,
  CASE WHEN acts AND s0 >= 2 THEN 'action_timeline[0]: t_start/t_end invalid' END, CASE WHEN acts AND 2 > duration THEN 'action_timeline[0]: ends beyond the clip' END,
  CASE WHEN acts AND e1 > duration THEN 'action_timeline[1]: ends beyond the clip' END, CASE WHEN acts AND 2.5 < s0 THEN 'action_timeline[1]: not ordered by t_start' END, CASE WHEN acts AND NOT list_contains(locked, actor) THEN 'action_timeline[1]: actor is not a locked entity' END,
  CASE WHEN resp = '' THEN 'expected_robot_response is required' END, CASE WHEN NOT robot THEN 'no robot entity is available to react' END, CASE WHEN NOT responds THEN 'action_timeline must include a robot response after the trigger' END,
  CASE WHEN p % 5 = 0 THEN 'expected_labels is empty' END, CASE WHEN p % 13 = 0 THEN 'scenario_id is empty' END, CASE WHEN row_number() OVER (PARTITION BY world, scenario_id ORDER BY line) > 1 THEN 'scenario_id is a duplicate' END) AS errors FROM er)"""


def oracle_sql() -> dict[str, str]:
    return {
        "contract_errors": f"""SELECT s_suppkey AS world, concat_ws('; ', CASE WHEN s_suppkey % 5 = 0 THEN 'object_registry must hold exactly the locked entities: ' || {ARM} || ', worker' END, CASE WHEN s_suppkey % 6 = 0 THEN 'scene_registry.scene_id is required' END,
            CASE WHEN s_suppkey % 4 = 0 THEN 'identity_checks must not be empty' END, CASE WHEN s_suppkey % 7 = 0 THEN 'locked_entities must include a robot' END) AS errors FROM supplier""",
        "scenario_errors": WORLDS + " SELECT world, line, errors FROM told",
        "repair_rounds": WORLDS + ", b AS (SELECT world, line, row_number() OVER (PARTITION BY world ORDER BY line) AS n FROM told WHERE errors <> '') SELECT t.world, count(*) AS n, count(b.line) AS n_fixed, CAST(sum(b.line) AS BIGINT) AS fixed_lines FROM told t LEFT JOIN b ON b.world = t.world AND b.line = t.line AND b.n <= 5 GROUP BY 1",
        "verifier_packets": WORLDS
        + """ SELECT line, '0.0=worker: drops_the box' || CASE WHEN p % 8 = 0 THEN '; ' || actor || ': ' || (['sings', 'stops_and waits', 'safely put down'])[p % 3 + 1] ELSE '' END || ' | ' || CAST(trig AS DOUBLE) || '=the box slips | ' || CAST(duration AS DOUBLE) || '=' || actor || ': ' || (['sings', 'stops_and waits', 'safely put down'])[p % 3 + 1] AS keyframes,
            'scene ' || p AS scenario_prompt, CASE WHEN robot THEN 'mobile robot' ELSE 'arm' END || ',storage box,person' AS expected_objects, (['slip', 'collision', 'fire'])[q % 3 + 1] AS expected_action, resp AS expected_outcome, CASE WHEN scene THEN 'hall' ELSE '' END AS locked_scene_id, arm || ',box,worker' AS locked_entity_ids FROM er WHERE acts""",
        "scenario_check": "WITH " + TRACKS_SQL.rstrip().rstrip(",")
        + """, d AS (SELECT episode_id, coalesce(list_sort(list(DISTINCT label) FILTER (NOT is_person)), []) AS o, bool_or(is_person) AS p FROM tracks GROUP BY 1), e AS (SELECT episode_id, CASE WHEN p THEN list_concat(['person'], o) ELSE o END AS d, p, list_sort(['human', 'object_1', 'small object_3', 'tool_' || (episode_id % 3)]) AS x FROM d)
            SELECT episode_id, array_to_string(d, ',') AS detected, array_to_string(x, ',') AS expected, array_to_string([y FOR y IN x IF NOT (len([z FOR z IN d IF contains(z, y) OR contains(y, z)]) > 0 OR (y = 'human' AND p))], ',') AS missing FROM e""",
        "run_lists": RUNS_SQL + "SELECT id, CASE WHEN good THEN 'accepted' ELSE 'quarantined' END AS list FROM ok",
        "not_accepted": RUNS_SQL + "SELECT id, CASE zones % 4 WHEN 1 THEN 'reject' ELSE 'review' END AS verdict, CASE WHEN batch % 2 = 0 THEN 'blurred; cut' ELSE 'no reason given' END AS why FROM runs WHERE zones % 4 IN (1, 2)",
        "clamped_counts": "SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE least(greatest(floor(o_totalprice / 10000 + 0.5), 1), 40) END AS INTEGER) AS n FROM orders",
        "first_errors": RUNS_SQL + "SELECT batch, coalesce(arg_min(CASE WHEN status = 'failed' THEN 'run ' || id WHEN label_status = 'failed' THEN 'label ' || id END, id) FILTER (status = 'failed' OR coalesce(label_status = 'failed', false)), CASE WHEN batch % 2 = 0 THEN 'batch error' ELSE 'Generation or labeling failed.' END) AS error FROM runs GROUP BY batch",
        "safe_paths": "SELECT p_partkey, p_partkey % 4 NOT IN (1, 2) AND p_partkey % 6 <> 0 AS safe FROM part",
    }
