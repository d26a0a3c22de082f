"""The folder that the driver and all executors share, for checkpoints and for tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: What ``held`` keeps in each session, by name.
_HELD: dict[tuple[int, str], DataFrame] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where it is unset, as in tests, a folder of our own on a local master; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='motionlake-')}")
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get()
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str) -> DataFrame:
    """df, kept in memory and on disk until the next table of that name is; an earlier one that is still used is made again."""
    key = (id(df.sparkSession), name)
    before = _HELD.pop(key, None)
    if before is not None:
        before.unpersist()
    _HELD[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
    return _HELD[key]
