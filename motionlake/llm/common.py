"""Helpers the text operators share: table access, the shared folder, skew-safe joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or where it is unset, as in tests, one of our own on a
    local master; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="motionlake-")
            spark.sparkContext.setCheckpointDir(f"file://{root}")
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to meet a column of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def sheltered(work: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """work(docs), which gives the columns of docs, for docs of any column names: those that begin with two underscores, as the
    operators' own do, and those that have to be quoted have other names meanwhile."""
    odd = [c for c in docs.columns if c.startswith("__") or "." in c or "`" in c]
    if not odd:
        return work(docs)
    other = dict(zip(odd, fresh(docs, *[f"sheltered_{k}" for k in range(len(odd))]), strict=True))
    return work(docs.toDF(*[other.get(c, c) for c in docs.columns])).toDF(*docs.columns)


def forget(*frames: DataFrame) -> None:
    """Remove tables that ``written`` made and nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give freed memory back: an idle worker of one stage stays beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
