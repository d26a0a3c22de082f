"""Reading: guarded tables, JSON documents, arrays, folders as tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A Parquet table; of a known kind with its columns' types, whatever else it has."""
    return spark.read.schema(TABLES[kind]).parquet(path) if kind else spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, kind: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The table, or an empty one of its kind if it is missing or unreadable, and a table of notes."""
    notes = "label string, note string"
    try:
        return spark.read.parquet(path), spark.createDataFrame([], notes)
    except AnalysisException:
        return spark.createDataFrame([], TABLES[kind]), spark.createDataFrame([(label, "missing or unreadable: check skipped")], notes)


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Documents, one a file; broken ones are null rows with their text in _corrupt, or fail if strict."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.schema(schema).json(path) if strict else reader.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Untyped documents: path and doc (VARIANT, null where the text is no JSON)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One array of NPZ files as rows: path, index (array<int>) and value; nothing pickled is loaded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    if name in data:
                        a = np.asarray(data[name], dtype=float)
                        yield pd.DataFrame({"path": p, "index": list(np.ndindex(*a.shape)), "value": a.reshape(-1)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, index array<int>, value double")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size and time of all files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stage_board(episodes: DataFrame, manifests: DataFrame, stages: list[str]) -> DataFrame:
    """Each episode's stages with their status; pending where there is no manifest."""
    frame = episodes.select("episode_id", F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("place", "stage"))
    return frame.join(manifests.select("episode_id", "stage", "status"), ["episode_id", "stage"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key, by text or number."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__k = 1").drop("__k")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first source, and of the second those whose key the first lacks (disk before memory)."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def usable(rows: DataFrame, keys: list[str], conf: float = 0.05) -> DataFrame:
    """Keys that have a sample with a position and some confidence."""
    return rows.where(F.col("x").isNotNull() & (F.col("conf") > conf)).select(*keys).distinct()
