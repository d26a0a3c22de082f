"""Robots: joints found by name, the limits and home positions that follow, and feet that slide while they stand.

dofs: robot, dof, lo, hi (as configured). model: robot, joint (name), id, lo, hi, limited, home.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metres that a standing foot may move from one frame to the next.
MOST_SLIDE = 0.02


def resolved_joints(dofs: DataFrame, model: DataFrame) -> DataFrame:
    """dofs with joint: the model's joint of that name, else the one of the name without what stands before its first underscore;
    of several joints of one name the lowest id; null if there is none.

    Both names go through one equi-join, and the best match of each dof is an aggregate.
    """
    name = F.col("dof")
    ways = F.array(F.struct(F.lit(0).alias("rank"), name.alias("name")), F.struct(F.lit(1).alias("rank"), F.when(name.contains("_"), F.expr("substr(dof, locate('_', dof) + 1)")).alias("name")))
    asked = dofs.select("robot", "dof", F.inline(ways)).where("name IS NOT NULL")
    joint = F.struct("joint", "id", F.col("lo").alias("lo"), F.col("hi").alias("hi"), "limited", "home")
    known = model.where("joint IS NOT NULL").select("robot", F.col("joint").alias("name"), joint.alias("found"))
    best = asked.join(known, ["robot", "name"]).groupBy("robot", "dof").agg(F.min_by("found", F.struct("rank", "found.id")).alias("joint"))
    return dofs.join(best, ["robot", "dof"], "left")


def joint_limits(dofs: DataFrame, model: DataFrame) -> DataFrame:
    """robot, dof, joint (its name), lo, hi (the model's where it limits the joint, else as configured) and home: the model's
    position, for dofs without a joint the middle of their limits."""
    rows = resolved_joints(dofs, model)
    limit = lambda c: F.when(F.col("joint.limited"), F.col(f"joint.{c}")).otherwise(F.col(c)).alias(c)
    out = rows.select("robot", "dof", F.col("joint.joint").alias("joint"), limit("lo"), limit("hi"), F.col("joint.home").alias("home"))
    return out.withColumn("home", F.coalesce("home", (F.col("lo") + F.col("hi")) / 2))


def foot_slide(feet: DataFrame, keys: list[str], most: float = MOST_SLIDE) -> DataFrame:
    """keys, check, violations (frames), max_value, threshold and skipped, as ``quality.joint_physics`` tells its checks.

    feet: keys, frame, foot, x, y and contact. A foot slides if it is in contact at a frame and at its frame before and has moved
    along the ground; a frame counts once, whatever the number of feet. Unknown contact is none.
    """
    w = Window.partitionBy(*keys, "foot").orderBy("frame")
    moved = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    stands = F.coalesce(F.col("contact") & F.lag("contact").over(w), F.lit(False))
    frames = feet.withColumn("slide", F.when(stands, moved)).groupBy(*keys, "frame").agg(F.max("slide").alias("slide"))
    found = frames.groupBy(*keys).agg(F.count_if(F.col("slide") > most).alias("violations"), F.coalesce(F.max("slide"), F.lit(0.0)).alias("max_value"))
    return found.select(*keys, F.lit("foot_slide").alias("check"), "violations", "max_value", F.lit(float(most)).alias("threshold"), F.lit(False).alias("skipped"))
