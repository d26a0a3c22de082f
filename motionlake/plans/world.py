"""Queries of robots' joints and feet, sources chosen by their rows, frame documents and reference assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import choice, nested, robots
from .gate import rounded

#: Joints of a frame's document; what a view keeps of a sample.
JOINTS, SEEN = 6, 0.05
SLIDE = 0.2


def _robots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A brand is a robot, its parts are dofs with the vendor's name before them or without; some joints have two entries, some no
    limits; names of types end in underscores or begin with a vendor that isn't theirs."""
    part = adapters.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    joint = F.concat(F.lit("joint"), k)
    dof = F.when(k % 3 == 0, joint).when(k % 3 == 1, F.concat(F.lit("panda_"), joint)).otherwise(F.concat(F.lit("arm_left_"), joint))
    dofs = part.select(F.col("p_brand").alias("robot"), dof.alias("dof"), (-F.col("p_size") / 10).alias("lo"), (F.col("p_size") / 10 + 1).alias("hi"))
    named = F.when(k % 5 == 4, F.concat(F.lit("other"), k)).when(k % 9 == 2, F.concat(F.lit("left_"), joint)).when(k % 7 == 1, F.concat(F.lit("panda_"), joint)).otherwise(joint)
    model = part.withColumn("copy", F.explode(F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    model = model.select(F.col("p_brand").alias("robot"), named.alias("joint"), (k * 2 + F.col("copy")).alias("id"), (-F.col("p_retailprice") / 1000 - F.col("copy")).alias("lo"), (F.col("p_retailprice") / 1000).alias("hi"), (k % 6 != 0).alias("limited"), (F.col("p_size") / 100).alias("home"))
    return dofs, model


def robot_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robots.joint_limits(*_robots(spark, sf_dir)), 6, "lo", "hi", "home")


def foot_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands are feet here; they stand while they are seen well."""
    feet = adapters.hands(spark, sf_dir).where("joint_name = 'wrist'").select("episode_id", "frame", F.col("hand").alias("foot"), F.col("px").alias("x"), F.col("py").alias("y"), (F.col("conf") > 0.55).alias("contact"))
    return rounded(robots.foot_slide(feet, ["episode_id"], SLIDE), 6, "max_value")


def usable_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clicks, else views, else errors, of which one at least has a large value; a mock row where none has."""
    events = adapters.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    sources = [events.where(F.col("event_type") == kind) for kind in ("click", "view", "error")]
    mock = events.select("user_id").distinct().withColumns({"event_id": F.lit(-1).cast("long"), "value": F.lit(0.0)})
    rows = choice.first_usable(sources, ["user_id"], F.col("value") > 150, mock)
    return rows.select("user_id", "event_id", "place", "mock", "value")


def replaced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns; where the assistant says long things, these replace all of its turns."""
    talk = adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    tracked = talk.where("role = 'assistant' AND size > 1200").withColumn("turn", F.col("turn") + 100)
    return choice.replaced(talk, tracked, ["conv_id"], F.col("role") == "assistant")


def frame_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints of both hands as entities of an episode; some joints and depths are missing."""
    hands = adapters.hands(spark, sf_dir)
    place = F.array_position(F.array(*[F.lit(j) for j in adapters.JOINTS]), F.col("joint_name")).cast("int") - 1
    rows = hands.select("episode_id", (F.col("hand") == "right").cast("int").alias("entity_id"), "frame", "t", (place * 2).alias("joint_idx"), F.when(F.col("frame") % 7 == 0, float("nan")).otherwise(F.col("px")).alias("x"), F.col("py").alias("y"), F.when(F.col("frame") % 5 != 0, F.col("pz")).alias("z"), "conf")
    return nested.frame_documents(rows.where("frame % 11 != 3 OR joint_idx != 2"), ["episode_id"], JOINTS)


def _contract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A size of parts is a world, parts are its entities; some anchors are given."""
    part, k = adapters.table(spark, sf_dir, "part"), F.col("p_partkey")
    entities = part.select(
        F.col("p_size").alias("world_id"), F.concat(F.lit("part_"), k).alias("id"), F.when(k % 7 != 0, F.col("p_type")).alias("type"), F.when(k % 3 != 0, F.col("p_name")).alias("appearance"),
        F.when(k % 4 != 0, F.col("p_brand")).alias("material"), F.when(k % 6 == 1, F.concat(F.lit("the "), "p_name")).alias("identity"),
    )
    given = part.where("p_partkey % 5 = 0").select(
        F.col("p_size").alias("world_id"), F.concat(F.lit("part_"), k).alias("entity_id"), F.col("p_name").alias("shape"), F.lit("steel").alias("material"), F.lit("grey").alias("color"), F.lit("").alias("details"),
        nested.words(["front_view", "top_view"]).alias("views"), nested.words(["do not bend"]).alias("drift"),
    )
    worlds = part.select(F.col("p_size").alias("world_id")).distinct().select("world_id", F.concat(F.lit("hall "), "world_id").alias("layout"), F.lit("concrete").alias("floor"), F.lit("daylight").alias("lighting"), F.when(F.col("world_id") % 2 == 0, "an even hall").alias("description"))
    scenes = worlds.where("world_id % 7 = 0").select("world_id", F.concat(F.lit("scene_"), "world_id").alias("scene_id"), "layout", F.lit("plain").alias("background"), "lighting", F.lit("map").alias("spatial_map"), nested.words(["wide"]).alias("views"), nested.words([]).cast("array<string>").alias("drift"))
    return nested.object_anchors(entities, given, "world_id"), nested.scene_anchors(worlds, scenes, "world_id"), worlds


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, _, _ = _contract(spark, sf_dir)
    return objects.select("world_id", "entity_id", "shape", "material", "color", "details", F.array_join("views", ",").alias("views"), F.array_join("drift", ",").alias("drift"))


def reference_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, scenes, worlds = _contract(spark, sf_dir)
    own = worlds.where("world_id % 11 = 0").select("world_id", F.lit("own").alias("asset_id"), F.lit("canvas").alias("kind"), F.lit("own.png").alias("target"), F.lit("Given.").alias("description"), F.lit("own").alias("source"))
    return nested.reference_assets(objects, scenes, own, "world_id")


def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, scenes, worlds = _contract(spark, sf_dir)
    own = worlds.where("world_id % 13 = 0").select("world_id", F.lit("own").alias("check_id"), F.lit("object").alias("scope"), F.lit("own").alias("target_id"), F.lit("look").alias("method"), F.lit("same").alias("pass_condition"))
    return nested.identity_checks(objects, scenes, own, "world_id")


NAMES = [robot_joints, foot_slide, usable_series, replaced_labels, frame_documents, anchors, reference_assets, identity_checks]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


N = adapters.EPISODE_FRAMES
EMBEDDED = f"em AS (SELECT vec_id // {N} AS episode_id, vec_id % {N} AS frame, (vec_id % {N}) / 30.0 AS t, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"


def _contract_sql() -> str:
    text = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"""WITH p AS (SELECT p_size AS world_id, 'part_' || p_partkey AS entity_id, p_partkey AS k, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS type, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS appearance,
  CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS material, CASE WHEN p_partkey % 6 = 1 THEN 'the ' || p_name END AS ident FROM part),
objects AS (SELECT world_id, entity_id, CASE WHEN k % 5 = 0 THEN p_name ELSE coalesce(ident, appearance, type, entity_id) END AS shape, CASE WHEN k % 5 = 0 THEN 'steel' ELSE coalesce(material, '{nested.NO_MATERIAL}') END AS material,
  CASE WHEN k % 5 = 0 THEN 'grey' ELSE coalesce(appearance, '{nested.NO_COLOR}') END AS color, CASE WHEN k % 5 = 0 THEN '' ELSE coalesce(appearance, '') END AS details,
  CASE WHEN k % 5 = 0 THEN ['front_view', 'top_view'] ELSE {text(nested.OBJECT_VIEWS)} END AS views, CASE WHEN k % 5 = 0 THEN ['do not bend'] ELSE {text(nested.OBJECT_DRIFT)} END AS drift FROM p),
scenes AS (SELECT DISTINCT p_size AS world_id, CASE WHEN p_size % 7 = 0 THEN 'scene_' || p_size ELSE CAST(p_size AS VARCHAR) END AS scene_id, CASE WHEN p_size % 7 = 0 THEN ['wide'] ELSE {text(nested.SCENE_VIEWS)} END AS views FROM part)"""


def oracle_sql() -> dict[str, str]:
    num = lambda c, d=nested.DIGITS: f"printf('%.{d}f', round({c}, {d}) + 0.0)"
    joints = f"(VALUES {', '.join(f'({2 * i}, {at})' for i, at in enumerate(adapters.JOINTS.values()))}) AS j(k, o)"
    joint = f"""'[' || CASE WHEN frame % 7 = 0 THEN 'null' ELSE {num(f"e[{adapters.HANDS['left']} + o + 1]")} END || ', ' || {num(f"e[{adapters.HANDS['left']} + o + 2]")} || ', ' || CASE WHEN frame % 5 = 0 THEN '0.0000' ELSE {num(f"e[{adapters.HANDS['left']} + o + 3]")} END
        || ', ' || {num(f"least(1.0, 0.4 + 2 * abs(e[{adapters.HANDS['left']} + o + 1]))", 3)} || ']'"""
    contract = _contract_sql()
    return {
        "robot_joints": """WITH d AS (SELECT p_brand AS robot, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'panda_' ELSE 'arm_left_' END || 'joint' || p_partkey AS dof, -p_size / 10 AS lo, p_size / 10 + 1 AS hi FROM part),
            m AS (SELECT p_brand AS robot, CASE WHEN p_partkey % 5 = 4 THEN 'other' || p_partkey WHEN p_partkey % 9 = 2 THEN 'left_joint' || p_partkey WHEN p_partkey % 7 = 1 THEN 'panda_joint' || p_partkey ELSE 'joint' || p_partkey END AS joint, p_partkey * 2 + c AS id,
                -p_retailprice / 1000 - c AS lo, p_retailprice / 1000 AS hi, p_partkey % 6 <> 0 AS limited, p_size / 100 AS home FROM part, range(2) r(c) WHERE c = 0 OR p_partkey % 4 = 0),
            w AS (SELECT d.robot, dof, m.*, row_number() OVER (PARTITION BY d.robot, dof ORDER BY m.joint <> dof, m.id) AS n FROM d JOIN m ON m.robot = d.robot AND (m.joint = dof OR (contains(dof, '_') AND m.joint = substr(dof, strpos(dof, '_') + 1)))),
            f AS (SELECT d.robot, d.dof, w.joint, CASE WHEN w.limited THEN w.lo ELSE d.lo END AS lo, CASE WHEN w.limited THEN w.hi ELSE d.hi END AS hi, w.home FROM d LEFT JOIN w ON w.robot = d.robot AND w.dof = d.dof AND n = 1)
            SELECT robot, dof, joint, CAST(round(lo, 6) AS DOUBLE) AS lo, CAST(round(hi, 6) AS DOUBLE) AS hi, CAST(round(coalesce(home, (lo + hi) / 2), 6) AS DOUBLE) AS home FROM f""",
        "foot_slide": f"""WITH {EMBEDDED}, h AS (SELECT episode_id, frame, hand, e[b + 1] AS x, e[b + 2] AS y, least(1.0, 0.4 + 2 * abs(e[b + 1])) > 0.55 AS c FROM em CROSS JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in adapters.HANDS.items())}) AS h(hand, b)),
            s AS (SELECT episode_id, frame, CASE WHEN c AND lag(c) OVER w THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) END AS s FROM h WINDOW w AS (PARTITION BY episode_id, hand ORDER BY frame)),
            f AS (SELECT episode_id, frame, max(s) AS s FROM s GROUP BY ALL) SELECT episode_id, 'foot_slide' AS check, count(*) FILTER (s > {SLIDE}) AS violations, round(coalesce(max(s), 0), 6) AS max_value, CAST({SLIDE} AS DOUBLE) AS threshold, false AS skipped FROM f GROUP BY 1""",
        "usable_series": """WITH k AS (SELECT user_id, event_id, value, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS place FROM events WHERE event_type IN ('click', 'view', 'error')),
            u AS (SELECT DISTINCT user_id FROM events), b AS (SELECT u.user_id, min(place) FILTER (value > 150) AS best FROM u LEFT JOIN k USING (user_id) GROUP BY 1)
            SELECT user_id, event_id, CAST(place AS INTEGER) AS place, false AS mock, value FROM k JOIN b USING (user_id) WHERE place = best UNION ALL SELECT user_id, -1, 3, true, 0.0 FROM b WHERE best IS NULL""",
        "replaced_labels": """WITH t AS (SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS size FROM conversations), b AS (SELECT * FROM t WHERE role = 'assistant' AND size > 1200)
            SELECT * FROM t WHERE role IS DISTINCT FROM 'assistant' OR conv_id NOT IN (SELECT conv_id FROM b) UNION ALL SELECT conv_id, turn + 100, role, size FROM b""",
        "frame_documents": f"""WITH {EMBEDDED}, j AS (SELECT episode_id, frame, t, k, {joint} AS j FROM em CROSS JOIN {joints} WHERE frame % 11 <> 3 OR k <> 2),
            s AS (SELECT f.episode_id, f.frame, f.t, i, coalesce(j, '[null, null, 0.0000, 0.000]') AS j FROM (SELECT DISTINCT episode_id, frame, t FROM j) f CROSS JOIN range({JOINTS}) r(i) LEFT JOIN j ON j.episode_id = f.episode_id AND j.frame = f.frame AND j.k = i),
            m AS (SELECT episode_id, max(frame) + 1 AS n_frames, list_sort(list(DISTINCT t)) AS ts FROM j GROUP BY 1),
            g AS (SELECT episode_id, frame, min(t) AS t, string_agg(j, ', ' ORDER BY i) AS js FROM s GROUP BY ALL)
            SELECT episode_id, CAST(round(1 / (ts[2] - ts[1]), 2) AS DOUBLE) AS fps, n_frames, frame, '{{"t": ' || {num('t')} || ', "frame": ' || frame || ', "joints": [' || js || ']}}' AS doc FROM g JOIN m USING (episode_id)""",
        "anchors": contract + " SELECT world_id, entity_id, shape, material, color, details, array_to_string(views, ',') AS views, array_to_string(drift, ',') AS drift FROM objects",
        "reference_assets": contract
        + f""", v AS (SELECT world_id, 'object_view' AS kind, entity_id AS source, unnest(views) AS view FROM objects UNION ALL SELECT world_id, 'scene_view', scene_id, unnest(views) FROM scenes)
            SELECT world_id, source || '_' || view AS asset_id, kind, 'references/' || source || '_' || view || '.png' AS target, 'Canonical ' || view || ' reference for ' || source || '.' AS description, source FROM v WHERE world_id % 11 <> 0
            UNION ALL SELECT world_id, scene_id || '_canvas', 'canvas', 'canvas.png', '{nested.CANVAS}', scene_id FROM scenes WHERE world_id % 11 <> 0 UNION ALL SELECT world_id, 'own', 'canvas', 'own.png', 'Given.', 'own' FROM scenes WHERE world_id % 11 = 0""",
        "identity_checks": contract
        + f""" SELECT world_id, entity_id || '_crop_similarity' AS check_id, 'object' AS scope, entity_id AS target_id, '{nested.OBJECT_METHOD}' AS method, '{nested.OBJECT_PASS}' AS pass_condition FROM objects WHERE world_id % 13 <> 0
            UNION ALL SELECT world_id, scene_id || '_layout_similarity', 'scene', scene_id, '{nested.SCENE_METHOD}', '{nested.SCENE_PASS}' FROM scenes WHERE world_id % 13 <> 0 UNION ALL SELECT world_id, 'own', 'object', 'own', 'look', 'same' FROM scenes WHERE world_id % 13 = 0""",
    }
