"""Jobs made from a prompt without a model: seeded draws, spaced cameras; and what tells that a job's files have changed.

A draw is told by a hash of its seed's parts, so it is the same wherever and whenever it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Times of day and styles of motion that are drawn from, lights, and the least size of a file that is told by its size.
TIMES_OF_DAY = ["morning", "midday", "golden hour", "dusk", "night (interior lighting)"]
MOTION_STYLES = ["natural pace", "slow and deliberate", "brisk and energetic", "hesitant with pauses", "smooth and continuous"]
DAY_LIGHT, NIGHT_LIGHT = "soft natural light", "warm interior lighting"
SMALL_FILE = 8 << 20


def drawn(n: int, *parts: Column) -> Column:
    """A number from 0 to n - 1 for these parts of a seed: the first 48 bits of their SHA-256, joined by colons, modulo n."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return (F.conv(F.left(digest, F.lit(12)), 16, 10).cast("long") % n).cast("int")


def one_of(values: list[str], *parts: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), drawn(len(values), *parts))


def expanded_events(jobs: DataFrame, n: int) -> DataFrame:
    """job, event_id, motion_style, time_of_day, lighting and base_prompt: n events of each job (job, prompt, seed; without a seed the
    prompt is the seed)."""
    seed = F.coalesce(F.col("seed").cast("string"), F.col("prompt"))
    rows = jobs.select("job", "prompt", seed.alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    rows = rows.select("job", "prompt", "i", one_of(TIMES_OF_DAY, F.col("seed"), F.col("i"), F.lit("time")).alias("time_of_day"), one_of(MOTION_STYLES, F.col("seed"), F.col("i"), F.lit("style")).alias("motion_style"))
    light = F.when(F.contains("time_of_day", F.lit("night")), NIGHT_LIGHT).otherwise(DAY_LIGHT)
    text = F.concat(F.lit("A person: "), "prompt", F.lit(". The motion is "), "motion_style", F.lit(", realistic human biomechanics, subject fully visible"))
    return rows.select("job", F.format_string("e%02d", "i").alias("event_id"), "motion_style", "time_of_day", light.alias("lighting"), text.alias("base_prompt"))


def expanded_cameras(jobs: DataFrame, cameras: str = "cameras") -> DataFrame:
    """job, cam_id, azimuth_deg, height_m, distance_m, fov_deg and description: as many cameras as each job asks for, spaced around
    the subject."""
    rows = jobs.where(F.col(cameras) > 0).select("job", F.col(cameras).alias("n"), F.explode(F.sequence(F.lit(0), F.col(cameras).cast("int") - 1)).alias("i"))
    rows = rows.select("job", "i", (F.col("i") * 360.0 / F.col("n")).alias("azimuth_deg"), (1.0 + 0.6 * (F.col("i") % 3)).alias("height_m"), (2.5 + 0.8 * F.col("i")).alias("distance_m"), (60.0 + 5.0 * (F.col("i") % 3)).alias("fov_deg"))
    text = F.format_string("Shot from a static camera at %.1fm height, %.1fm away, %.0f degrees around the subject", "height_m", "distance_m", "azimuth_deg")
    return rows.select("job", F.concat(F.lit("cam"), "i").alias("cam_id"), "azimuth_deg", "height_m", "distance_m", "fov_deg", text.alias("description"))


def output_hashes(declared: DataFrame, files: DataFrame, key: str, small: int = SMALL_FILE) -> DataFrame:
    """key, entries and output_hash of the outputs that a key declares (key, output: a file or a folder).

    files: key, path, size, content (may be null for large files). Small files are told by their content, large ones by their size,
    outputs that aren't there as missing. A file meets the folders above it and itself by equality, whatever their depth.
    """
    token = F.when(F.col("size") < small, F.sha2("content", 256)).otherwise(F.concat(F.lit("size:"), F.col("size").cast("string")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = files.select(F.col(key).alias("__k"), "path", F.col("size").cast("long").alias("size"), token.alias("token"), F.explode(above).alias("at"))
    rows = declared.select(key, "output").join(known, (F.col(key) == F.col("__k")) & (F.col("output") == F.col("at")), "left")
    entry = F.struct(F.coalesce("path", "output").alias("path"), F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("token", F.lit("missing")).alias("token"))
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    told = F.transform("e", lambda x: F.concat(F.lit('["'), x["path"], F.lit('", '), x["size"].cast("string"), F.lit(', "'), x["token"], F.lit('"]')))
    text = F.concat(F.lit("["), F.array_join(told, ", "), F.lit("]"))
    return one.select(key, F.size("e").cast("long").alias("entries"), F.sha2(text, 256).alias("output_hash"))


def missing_folders(files: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """key and missing: the expected folders (of any depth) that hold none of the key's files (key, path), in the order given."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    there = files.select(key, F.explode(above).alias("folder"))
    found = there.where(F.col("folder").isin(expected)).groupBy(key).agg(F.collect_set("folder").alias("there"))
    rows = files.select(key).distinct().join(found, key, "left")
    return rows.select(key, F.array_except(F.array(*[F.lit(e) for e in expected]), F.coalesce("there", F.array().cast("array<string>"))).alias("missing"))


def training_counts(results: DataFrame) -> DataFrame:
    """Videos of an extraction (subject, n_frames, error), of each subject, frames and errors."""
    return results.agg(
        F.count("*").alias("n_videos"), F.count_if(F.col("subject") == "human").alias("n_human"), F.count_if(F.col("subject") == "animal").alias("n_animal"), F.coalesce(F.sum("n_frames"), F.lit(0)).alias("n_frames"), F.count_if(F.col("error").isNotNull()).alias("n_errors")
    )
