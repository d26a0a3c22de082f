"""Writing: tables under contract, documents, logs, training arrays, bounded histories."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import contract_violations
from ..schemas import REQUIRED


class ContractError(ValueError):
    pass


def write_table(df: DataFrame, path: str, kind: str, keys: list[str], by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Check a table's contract, then write it, partitioned if asked for; what breaks the contract isn't written."""
    broken = [f"{r.rule} ({r.n})" for r in contract_violations(df, REQUIRED[kind], keys).collect()]
    if broken:
        raise ContractError(f"{kind}: " + "; ".join(broken))
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a line, with nulls left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def dense_arrays(rows: DataFrame, key: str, frame: str, name: str, names: list[str], value: str) -> DataFrame:
    """NPZ bytes for each key: t (frames) and data (frames x names), NaN where there is no sample. A key is a clip."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index=frame, columns=name, values=value).reindex(columns=names).sort_index()
        out = io.BytesIO()
        np.savez_compressed(out, t=wide.index.to_numpy(), data=wide.to_numpy(dtype=float))
        return pd.DataFrame({key: [part[key].iloc[0]], "frames": [len(wide)], "content": [out.getvalue()]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, frames long, content binary")


def load_dense(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as data:
        return data["t"], data["data"]


def bounded_history(old: DataFrame, new: DataFrame, key: str, order: str, n: int = 500) -> DataFrame:
    """History with new rows behind it, known keys left out; the last n by order stay."""
    both = old.unionByName(new.join(old.select(key), key, "left_anti"))
    return both.orderBy(F.desc(order), F.desc(key)).limit(n)


def report_documents(scores: DataFrame, violations: DataFrame, key: str = "episode_id") -> DataFrame:
    """A JSON report for each clip: its score and verdict, and its violations worst first."""
    v = F.struct((-F.col("severity")).alias("o"), "type", F.round("severity", 2).alias("severity"), "frames", "track_id")
    found = violations.groupBy(key).agg(F.array_sort(F.collect_list(v)).alias("v"))
    plain = F.transform("v", lambda x: F.struct(x["type"].alias("type"), x["severity"].alias("severity"), x["frames"].alias("frames"), x["track_id"].alias("track_id")))
    rows = scores.join(found, key, "left")
    return rows.select(key, F.to_json(F.struct(F.round("score", 2).alias("score"), "plausible", "reason", F.coalesce(plain, F.array().cast("array<struct<type:string,severity:double,frames:array<bigint>,track_id:bigint>>")).alias("violations"))).alias("report"))


def markdown(rows: DataFrame, columns: list[str]) -> Iterator[str]:
    """Lines of a Markdown table of a small report."""
    yield "| " + " | ".join(columns) + " |"
    yield "|" + "---|" * len(columns)
    for r in rows.select(*columns).toLocalIterator():
        yield "| " + " | ".join("" if x is None else str(x) for x in r) + " |"
