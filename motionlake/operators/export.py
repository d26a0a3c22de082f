"""Episodes as wide training rows, their metadata and validation, and the delivery of a job.

Components are long tables (keys, frame, value as array<float>); one shuffle by episode brings all of them together. A
component that doesn't have exactly one row for each frame of its episode is left out of that episode and named in its
metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import interval_join

BLOCK_S = 8.0


def floats(*columns: Column) -> Column:
    return F.array(*[c.cast("float") for c in columns])


def episode_rows(frames: DataFrame, components: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, frame, t, a column for each component (null where it is left out), n_frames and omitted (names with the reason)."""
    spine = frames.select(*keys, "frame", F.lit("").alias("__name"), floats().alias("__v"), F.col("t").cast("double").alias("__t"))
    parts = [c.select(*keys, "frame", F.lit(n).alias("__name"), F.col("value").alias("__v"), F.lit(None).cast("double").alias("__t")) for n, c in components.items()]
    long = reduce(DataFrame.unionByName, parts, spine).repartition(*keys)
    of = {n: F.first(F.when(F.col("__name") == n, F.col("__v")), ignorenulls=True).alias(n) for n in components}
    rows = long.groupBy(*keys, "frame").agg(F.max("__t").alias("t"), F.count_if(F.col("__name") == "").alias("__here"), *of.values())
    w = Window.partitionBy(*keys)
    whole = F.sum(F.least("__here", F.lit(1))).over(w)
    seen = {n: F.count(F.col(f"`{n}`")).over(w) for n in components}
    inside = {n: F.count(F.when(F.col("__here") > 0, F.col(f"`{n}`"))).over(w) for n in components}
    counted = rows.withColumn("n_frames", whole).withColumns({f"__c{i}": F.struct(seen[n].alias("seen"), inside[n].alias("inside")) for i, n in enumerate(components)})
    fits = lambda i: (F.col(f"__c{i}.seen") == F.col("n_frames")) & (F.col(f"__c{i}.inside") == F.col("n_frames"))
    omitted = F.array_compact(F.array(*[F.when(F.col(f"__c{i}.seen") == 0, F.lit(n)).when(~fits(i), F.lit(f"{n} (frame mismatch)")) for i, n in enumerate(components)]))
    kept = [F.when(fits(i), F.col(f"`{n}`")).alias(n) for i, n in enumerate(components)]
    return counted.where("__here > 0").select(*keys, "frame", "t", *kept, "n_frames", omitted.alias("omitted"))


def subtask_index(frames: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame and the number of the last segment (place, start_s, end_s) that holds the frame's time, both ends included;
    -1 for none."""
    held = interval_join(frames.select(*keys, "frame", "t"), segments.select(*keys, "place", "start_s", "end_s"), keys, "t", "start_s", "end_s", BLOCK_S)
    found = held.groupBy(*keys, "frame").agg(F.max("place").alias("place"))
    return frames.select(*keys, "frame").join(found, [*keys, "frame"], "left").select(*keys, "frame", F.coalesce("place", F.lit(-1)).alias("subtask_index"))


def contact_flags(frames: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, contact_l and contact_r; frames without a row are without contact."""
    side = lambda hand: F.coalesce(F.bool_or(F.when(F.col("hand") == hand, F.col("contact"))), F.lit(False))
    rows = frames.select(*keys, "frame").join(touched, [*keys, "frame"], "left")
    return rows.groupBy(*keys, "frame").agg(side("left").alias("contact_l"), side("right").alias("contact_r"))


def episode_meta(rows: DataFrame, quality: DataFrame, keys: list[str], hz: float = 30.0) -> DataFrame:
    """A row an episode: length, duration, mean confidence of the camera's poses (keys, conf) and what is left out."""
    one = rows.groupBy(*keys).agg(F.max("n_frames").alias("length"), (F.max("t") + 1 / hz).alias("duration_s"), F.first("omitted").alias("omitted"))
    return one.join(quality.groupBy(*keys).agg(F.avg("conf").alias("pose_quality")), keys, "left")


def validate_export(rows: DataFrame, meta: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Whether an export has a row for each frame of its episode and says so in its metadata."""
    want = frames.groupBy(*keys).agg(F.count("*").alias("n_frames"))
    have = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    found = want.join(have, keys, "left").join(meta.select(*keys, "length"), keys, "left")
    ok = (F.col("rows") == F.col("n_frames")) & (F.col("length") == F.col("n_frames"))
    return found.select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(ok, F.lit(False)).alias("passed"))


def delivery_funnel(variants: DataFrame, job: str) -> DataFrame:
    """job, place, step and n of a delivery, step by step, from its variants.

    variants: job, variant_id, generated, verdict, accepted, exported, session. Counts are independent of each other.
    """
    steps = {
        "requested (events x cams)": F.count("*"), "generated": F.count_if("generated"), "verification: accept": F.count_if(F.col("verdict") == "accept"), "verification: review": F.count_if(F.col("verdict") == "review"),
        "verification: reject": F.count_if(F.col("verdict") == "reject"), "pipeline accepted": F.count_if("accepted"), "exported": F.count_if(F.col("accepted") & F.col("exported")), "multi-view sessions": F.count_distinct("session"),
    }
    one = variants.groupBy(job).agg(*[c.alias(f"s{i}") for i, c in enumerate(steps.values())])
    told = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("step"), F.col(f"s{i}").alias("n")) for i, n in enumerate(steps)])
    return one.select(job, F.explode(told).alias("x")).select(job, "x.*")


def deliverable(variants: DataFrame) -> DataFrame:
    """Episodes to copy: accepted ones whose export exists."""
    return variants.where(F.col("accepted") & F.col("exported"))


def rejections(variants: DataFrame, job: str) -> DataFrame:
    """A job's variants that were rejected, then those left to review, as one JSON list."""
    rank = F.when(F.col("verdict") == "reject", 0).otherwise(1)
    item = F.struct(rank.alias("k"), "variant_id", "verdict", "reasons")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["variant_id"].alias("variant_id"), x["verdict"].alias("verdict"), x["reasons"].alias("reasons")))
    return variants.where(F.col("verdict").isin("reject", "review")).groupBy(job).agg(F.to_json(listed).alias("rejected"))


def attached_labels(variants: DataFrame, columns: list[str]) -> DataFrame:
    """The provenance that goes beside an episode's labels, as JSON."""
    return variants.select("variant_id", F.to_json(F.struct(*columns)).alias("payload"))


def overview(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, d in counts.items()]
    return reduce(DataFrame.unionByName, parts).groupBy().pivot("name", list(counts)).agg(F.first("n"))
