"""Stages, hashes and exports: what must run again, and tables as others want them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import STAGES

#: Stages that run although an earlier one failed.
ALWAYS = ["qa", "package"]


def stage_edges(spark: SparkSession) -> DataFrame:
    rows = [(s, d, i) for i, (s, deps) in enumerate(STAGES.items()) for d in deps]
    return spark.createDataFrame(rows, "stage string, dep string, place int")


def closure(edges: DataFrame) -> DataFrame:
    """stage and each stage that it needs, directly or not: paths are doubled as often as the number of stages asks for, so
    this ends on a graph with cycles too."""
    found = edges.select("stage", "dep").distinct()
    for _ in range(found.select("stage").distinct().count().bit_length()):
        onward = found.select(F.col("stage").alias("dep"), F.col("dep").alias("further"))
        found = found.union(found.join(onward, "dep").select("stage", F.col("further").alias("dep"))).distinct()
    return found


def output_hash(files: DataFrame, keys: list[str], path: str, digest: str) -> DataFrame:
    """One hash for the files of a key, whatever their order."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", path, digest))), "\n")
    return files.groupBy(*keys).agg(F.sha2(lines, 256).alias("output_hash"), F.count("*").alias("n_files"))


def input_hash(manifests: DataFrame, edges: DataFrame, config: Column) -> DataFrame:
    """Hash of each episode's stage: its dependencies' output hashes in order, and the configuration."""
    deps = manifests.select("episode_id", F.col("stage").alias("dep"), "output_hash").join(edges.select("stage", "dep"), "dep")
    return deps.groupBy("episode_id", "stage").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "dep", "output_hash"))), config), 256).alias("input_hash"))


def may_skip(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """now with skip: the stage succeeded before with the same inputs and configuration."""
    old = before.select(*keys, F.col("status").alias("__s"), F.col("input_key").alias("__i"), F.col("config_key").alias("__c"))
    same = (F.col("__s") == "success") & (F.col("__i") == F.col("input_key")) & (F.col("__c") == F.col("config_key"))
    return now.join(old, keys, "left").withColumn("skip", F.coalesce(same, F.lit(False))).drop("__s", "__i", "__c")


def halted(manifests: DataFrame, place: Column) -> DataFrame:
    """manifests with halted: an earlier stage failed and this isn't one that always runs."""
    w = Window.partitionBy("episode_id").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((F.col("status") == "failed").cast("int")).over(w), F.lit(0)) == 1
    return manifests.withColumn("__p", place).withColumn("halted", failed & ~F.col("stage").isin(ALWAYS)).drop("__p")


def insert_if_absent(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base and those rows of new whose key it lacks."""
    return base.unionByName(new.join(base.select(key), key, "left_anti"))


def round_robin(jobs: DataFrame, order: str, scenarios: DataFrame, rank: str, n: int) -> DataFrame:
    """Job i (from 1) with scenario (i - 1) mod n; rank numbers the scenarios from 0."""
    return jobs.withColumn("__slot", (F.col(order) - 1) % n).join(scenarios, F.col("__slot") == F.col(rank)).drop("__slot")


def variants(events: DataFrame, event: str, cameras: list[str]) -> DataFrame:
    """Each event under each of the given cameras."""
    rows = events.withColumn("camera", F.explode(F.array(*[F.lit(c) for c in cameras])))
    return rows.withColumn("variant_id", F.concat_ws("_", event, "camera"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with file: the name, and _2, _3, ... behind it where it repeats."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("file", F.when(k == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), k)))


def wide(rows: DataFrame, keys: list[str], column: str, names: list[str], value: str, empty: float | None = None) -> DataFrame:
    """A row a key with a column for each of the names; the mean where several rows meet."""
    out = rows.groupBy(*keys).pivot(column, names).agg(F.avg(value))
    return out.fillna(empty, names) if empty is not None else out


def positional(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th rows of both sides within a key; what is left over on one side goes."""
    place = lambda d: d.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return place(left).join(place(right).withColumnRenamed(order, f"{order}_2"), [*keys, "place"])
