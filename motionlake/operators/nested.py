"""Nested documents from rows: frames filled from a spine of joints, reference assets and checks of a world's contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4


def number(value: Column, digits: int = DIGITS) -> Column:
    """A number as JSON: rounded, null where it is null or not a number."""
    shown = F.format_string(f"%.{digits}f", F.round(value, digits) + F.lit(0.0))
    return F.when(value.isNull() | F.isnan(value), F.lit("null")).otherwise(shown)


def frame_documents(rows: DataFrame, keys: list[str], joints: int) -> DataFrame:
    """keys, fps, n_frames, frame and doc: a JSON object of each frame with t and the joints 0 to joints - 1 in order.

    rows: keys, entity_id, frame, t, joint_idx, x, y, z, conf. The first entity of a key counts. A joint is [x, y, z, conf], a depth
    that isn't known being 0; a joint without a row is [null, null, 0, 0]; of several rows the last one by t counts. fps tells the
    first two times apart (30 if there is one); n_frames is one more than the largest frame.
    """
    w = Window.partitionBy(*keys)
    first = rows.where("entity_id IS NOT NULL AND frame IS NOT NULL").withColumn("__e", F.min("entity_id").over(w)).where("entity_id = __e")
    joint = F.concat(F.lit("["), F.concat_ws(", ", number(F.col("x")), number(F.col("y")), number(F.coalesce(F.nanvl("z", F.lit(0.0)), F.lit(0.0))), number(F.coalesce("conf", F.lit(0.0)), 3)), F.lit("]"))
    one = first.groupBy(*keys, "frame", "joint_idx").agg(F.max_by(joint, F.struct("t", joint)).alias("j"), F.min("t").alias("t"))
    frames = one.groupBy(*keys, "frame").agg(F.min("t").alias("t"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("joint_idx", F.lit(-1)), "j"))).alias("j"))
    empty = "[null, null, 0.0000, 0.000]"
    spine = F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), lambda k: F.coalesce(F.try_element_at("j", k), F.lit(empty)))
    doc = F.concat(F.lit('{"t": '), number(F.col("t")), F.lit(', "frame": '), F.col("frame").cast("string"), F.lit(', "joints": ['), F.array_join(spine, ", "), F.lit("]}"))
    times = first.groupBy(*keys).agg(F.array_sort(F.collect_set("t")).alias("ts"), (F.max("frame") + 1).alias("n_frames"))
    step = F.get("ts", F.lit(1)) - F.get("ts", F.lit(0))
    fps = F.when(F.size("ts") > 1, F.round(1 / step, 2)).otherwise(30.0)
    return frames.join(times.select(*keys, fps.alias("fps"), "n_frames"), keys).select(*keys, "fps", "n_frames", "frame", doc.alias("doc"))


# Views, drifts and words of anchors that nobody gave.
OBJECT_VIEWS = ["front_view", "side_view", "three_quarter_view"]
SCENE_VIEWS = ["wide_establishing", "left_angle", "right_angle", "empty_background_plate"]
OBJECT_DRIFT = ["do not change silhouette", "do not change color or material", "do not add readable text or logos"]
SCENE_DRIFT = ["do not move shelves, walls, floor lines or large fixtures", "do not change lighting family", "do not change visual style"]
NO_MATERIAL, NO_COLOR = "unspecified material", "unspecified color"
CANVAS = "Canonical full-scene visual anchor for the series."
OBJECT_METHOD = "compare sampled object crops to reference views with VLM and embedding similarity"
OBJECT_PASS = "same silhouette, material, color, scale and surface details across the series"
SCENE_METHOD = "compare sampled background frames to scene reference views with VLM and layout descriptors"
SCENE_PASS = "same background identity, spatial layout, lighting family and visual style"


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def object_anchors(entities: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, entity_id, shape, material, color, details, views and drift of every entity: as given, else told by the entity.

    entities: key, id, type, appearance, material, identity. given: key, entity_id and the same columns; of several the last by them.
    """
    told = ["shape", "material", "color", "details", "views", "drift"]
    known = given.where("entity_id IS NOT NULL").groupBy(key, "entity_id").agg(F.max(F.struct(*told)).alias("given"))
    own = F.struct(
        F.coalesce("identity", "appearance", "type", "id").alias("shape"), F.coalesce("material", F.lit(NO_MATERIAL)).alias("material"), F.coalesce("appearance", F.lit(NO_COLOR)).alias("color"),
        F.coalesce("appearance", F.lit("")).alias("details"), words(OBJECT_VIEWS).alias("views"), words(OBJECT_DRIFT).alias("drift"),
    )
    rows = entities.withColumnRenamed("id", "entity_id").join(known, [key, "entity_id"], "left").withColumnRenamed("entity_id", "id")
    return rows.select(key, F.col("id").alias("entity_id"), F.coalesce("given", own).alias("a")).select(key, "entity_id", "a.*")


def scene_anchors(worlds: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, scene_id, layout, background, lighting, spatial_map, views and drift of every world (key, layout, floor, lighting,
    description): as given, else told by its environment."""
    told = ["scene_id", "layout", "background", "lighting", "spatial_map", "views", "drift"]
    known = given.groupBy(key).agg(F.max(F.struct(*told)).alias("given"))
    own = F.struct(
        F.col(key).cast("string").alias("scene_id"), F.col("layout"), F.concat("layout", F.lit("; "), "floor", F.lit(" floor")).alias("background"), F.col("lighting"),
        F.coalesce("description", "layout").alias("spatial_map"), words(SCENE_VIEWS).alias("views"), words(SCENE_DRIFT).alias("drift"),
    )
    return worlds.join(known, key, "left").select(key, F.coalesce("given", own).alias("a")).select(key, "a.*")


def reference_assets(objects: DataFrame, scenes: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, asset_id, kind, target, description and source of every world: as given, else its canvas, each object's views and the
    scene's views."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def views(anchors: DataFrame, source: str, kind: str) -> DataFrame:
        rows = anchors.select(key, F.col(source).alias("source"), F.explode("views").alias("view"))
        name = text(F.col("source"), "_", F.col("view"))
        return rows.select(key, name.alias("asset_id"), F.lit(kind).alias("kind"), text("references/", name, ".png").alias("target"), text("Canonical ", F.col("view"), " reference for ", F.col("source"), ".").alias("description"), "source")

    canvas = scenes.select(key, text(F.col("scene_id"), "_canvas").alias("asset_id"), F.lit("canvas").alias("kind"), F.lit("canvas.png").alias("target"), F.lit(CANVAS).alias("description"), F.col("scene_id").alias("source"))
    made = canvas.unionByName(views(objects, "entity_id", "object_view")).unionByName(views(scenes, "scene_id", "scene_view"))
    return given.select(*made.columns).unionByName(made.join(given.select(key).distinct(), key, "left_anti"))


def identity_checks(objects: DataFrame, scenes: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, check_id, scope, target_id, method and pass_condition of every world: as given, else one of each object and the scene."""
    row = lambda df, scope, c, tail, method, passes: df.select(key, F.concat(c, F.lit(tail)).alias("check_id"), F.lit(scope).alias("scope"), F.col(c).alias("target_id"), F.lit(method).alias("method"), F.lit(passes).alias("pass_condition"))
    made = row(objects, "object", "entity_id", "_crop_similarity", OBJECT_METHOD, OBJECT_PASS).unionByName(row(scenes, "scene", "scene_id", "_layout_similarity", SCENE_METHOD, SCENE_PASS))
    return given.select(*made.columns).unionByName(made.join(given.select(key).distinct(), key, "left_anti"))
