"""Views of the driver's tables as the engine's tables; each has a DataFrame only, no rows of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One clip's constants: 800 x 600 pixels (a diagonal of 1000), 30 frames at 6 a second.
WIDTH, HEIGHT, N_FRAMES, FPS = 800, 600, 30, 6.0
#: Tracks of a clip: clips get more with the data, not larger.
CLIP_USERS = 10
#: Rows of a contact series.
CONTACT_ROWS = 50

#: Where each keypoint of a person stands in its box: shares of width and height.
LAYOUT = {
    0: (0.5, 0.05), 5: (0.3, 0.2), 6: (0.7, 0.2), 7: (0.15, 0.4), 8: (0.85, 0.4), 9: (0.0, 0.5), 10: (1.0, 0.5),
    11: (0.4, 0.5), 12: (0.6, 0.5), 13: (0.35, 0.75), 14: (0.65, 0.75), 15: (0.25, 1.0), 16: (0.75, 1.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: a track is a user, a frame a day, a clip CLIP_USERS users."""
    events = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long")
    return (
        events.groupBy(
            F.floor(F.col("user_id") / CLIP_USERS).cast("long").alias("episode_id"), (F.col("user_id") % 3 == 0).alias("is_person"), F.col("user_id").alias("track_id"), day.alias("frame")
        )
        .agg(
            F.min("value").alias("x1"),
            (F.max("value") + 20).alias("x2"),
            (4.0 * F.min(props_k())).alias("y1"),
            (4.0 * F.max(props_k()) + 20).alias("y2"),
            F.count("*").alias("n_events"),
        )
        .withColumn("label", F.when(F.col("is_person"), "person").otherwise(F.concat(F.lit("object_"), F.col("track_id") % 7)))
    )


def clips(tracks: DataFrame) -> DataFrame:
    return tracks.select("episode_id").distinct().select(
        "episode_id", F.lit(FPS).alias("fps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(N_FRAMES).cast("long").alias("n_frames")
    )


def keypoints(tracks: DataFrame) -> DataFrame:
    """Keypoints of persons, a row each."""
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("kpt_idx"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in LAYOUT.items()]))
    x = F.col("x1") + F.col("p.a") * (F.col("x2") - F.col("x1"))
    y = F.col("y1") + F.col("p.b") * (F.col("y2") - F.col("y1"))
    conf = F.least(F.lit(1.0), 0.4 + 0.05 * F.col("n_events"))
    return tracks.where("is_person").withColumn("p", place).select("episode_id", "track_id", "frame", "p.kpt_idx", x.alias("x"), y.alias("y"), conf.alias("conf"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user and kind of event: t seconds from 2024 on, value v and level k. Equal times keep the last."""
    events = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    return events.groupBy(F.col("user_id"), F.col("event_type"), t.alias("t")).agg(F.max_by("value", "event_id").alias("v"), F.max_by(props_k(), "event_id").cast("double").alias("k"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as intervals, a second for ten characters."""
    talk = table(spark, sf_dir, "conversations")
    size = F.length(F.coalesce("text", F.lit(""))) / 10.0
    ordered = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return talk.select("conv_id", "turn", "role", "text", (end - size).alias("start_s"), end.alias("end_s"))


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements 1 to 4 of each vector as a quaternion (w, x, y, z), and 5 to 8 as a second one."""
    e = F.col("embedding")
    part = lambda k: [e[k + i].cast("double").alias(n) for i, n in enumerate("wxyz")]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.struct(*part(0)).alias("q"), F.struct(*part(4)).alias("r"))


#: Frames of an episode that the vectors stand for, and where in a vector hands, joints and objects begin.
EPISODE_FRAMES = 50
HANDS = {"left": 0, "right": 9}
JOINTS = {"wrist": 0, "thumbTip": 3, "indexFingerTip": 6}
OBJECTS = {"box": 54, "cup": 46}


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double")).alias("e")
    frame = F.col("vec_id") % EPISODE_FRAMES
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / EPISODE_FRAMES).cast("long").alias("episode_id"), frame.alias("frame"), (frame / 30.0).alias("t"), e)


def _point(at: Column) -> list[Column]:
    return [F.get("e", at + i).alias(c) for i, c in enumerate(("px", "py", "pz"))]


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three joints of both hands in each frame, from parts of the vectors."""
    which = F.explode(F.array(*[F.struct(F.lit(h).alias("hand"), F.lit(j).alias("joint_name"), F.lit(b + o).alias("at")) for h, b in HANDS.items() for j, o in JOINTS.items()]))
    conf = F.least(F.lit(1.0), 0.4 + 2 * F.abs(F.get("e", F.col("w.at"))))
    return _frames(spark, sf_dir).withColumn("w", which).select("episode_id", "frame", "t", "w.hand", "w.joint_name", *_point(F.col("w.at")), conf.alias("conf"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two objects, one of which is missing in some frames."""
    which = F.explode(F.array(*[F.struct(F.lit(o).alias("object_id"), F.lit(b).alias("at")) for o, b in OBJECTS.items()]))
    rows = _frames(spark, sf_dir).withColumn("w", which).where((F.col("w.object_id") == "cup") | (F.col("frame") % 7 != 3))
    return rows.select("episode_id", "frame", "t", "w.object_id", *_point(F.col("w.at")), F.least(F.lit(1.0), 0.6 + F.abs(F.get("e", F.col("w.at") + 7))).alias("conf"))


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pelvis and head, some milliseconds after the camera's frames; some frames aren't valid."""
    which = F.explode(F.array(F.struct(F.lit("pelvis").alias("joint"), F.lit(20).alias("at")), F.struct(F.lit("head").alias("joint"), F.lit(23).alias("at"))))
    x = [F.get("e", F.col("w.at") + i) for i in range(3)]
    return _frames(spark, sf_dir).withColumn("w", which).select("episode_id", (F.col("t") + 0.004).alias("t"), "w.joint", x[0].alias("x"), x[1].alias("y"), (2 + x[2]).alias("z"), (F.col("frame") % 11 != 5).alias("valid"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses: q turns camera to world, raw is a quaternion as stored, next to the unit sphere."""
    e = [F.get("e", F.lit(i)) for i in range(64)]
    q = [F.lit(1.0), e[27] / 4, e[28] / 4, e[29] / 4]
    size = F.sqrt(1 + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    part = lambda k: F.struct(*[(c / size * k).alias(n) for c, n in zip(q, "wxyz", strict=True)])
    return _frames(spark, sf_dir).select("episode_id", "frame", "t", part(F.lit(1.0)).alias("q"), part(1 + e[30] / 200).alias("raw"), e[31].alias("px"), e[32].alias("py"), e[33].alias("pz"), (F.col("frame") % 13 != 6).alias("valid"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = {"fx": 1500.0, "fy": 1500.0, "cx": 320.0, "cy": 240.0, "width": 640.0, "height": 480.0}
    return _frames(spark, sf_dir).select("episode_id").distinct().select("episode_id", *[F.lit(v).alias(k) for k, v in fixed.items()])


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three joints of a robot with their limits."""
    which = F.posexplode(F.slice("e", 35, 3)).alias("joint", "q")
    return _frames(spark, sf_dir).select("episode_id", "frame", "t", which).select("episode_id", "frame", "t", "joint", (3 * F.col("q")).alias("q"), F.lit(-0.9).alias("lo"), F.lit(0.9).alias("hi"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of a hand to an object: a series of CONTACT_ROWS rows for each object."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / CONTACT_ROWS).cast("long").alias("object_id"), F.col("vec_id").alias("frame"), (F.abs(F.col("embedding")[0].cast("double")) / 10).alias("distance")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pipeline runs; the zones are the order's items."""
    zones = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("zones"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    review = F.when(F.col("o_custkey") % 4 == 0, "failed").when(F.col("o_custkey") % 4 == 1, None).otherwise("passed")
    label = F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderstatus") == "F"), "completed").when(F.col("o_custkey") % 3 == 1, "failed")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
            F.col("o_custkey").alias("batch"),
            status.alias("status"),
            review.alias("review_status"),
            label.alias("label_status"),
            F.col("o_orderpriority").alias("camera"),
            F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 1000).alias("seconds"),
        )
        .join(zones, "id", "left")
        .withColumn("zones", F.coalesce("zones", F.lit(0)).cast("long"))
    )


#: Stage of an episode by the number of an order's line.
LINE_STAGES = ["ingest", "geometry", "human_body", "hands", "objects", "semantics", "package"]


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as an episode's stage manifests."""
    items = table(spark, sf_dir, "lineitem")
    stage = F.element_at(F.array(*[F.lit(s) for s in LINE_STAGES]), F.col("l_linenumber"))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("success")
    return items.groupBy(F.col("l_orderkey").alias("episode_id"), stage.alias("stage")).agg(
        F.min(status).alias("status"), F.sum("l_quantity").alias("quantity"), F.max("l_partkey").alias("input_key"), F.max("l_suppkey").alias("config_key")
    )
