"""Queries of dataset archives: turns of conversations as the files of samples, written, committed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..sources import archives as A
from ..sources import shared

BATCHES, SHARED = 20, 40


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a job; two or so of a batch share a scenario. Turns are files of one kind or another."""
    conv = F.col("conv_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in A.KINDS]), ((F.col("turn") + conv) % 7 + 1).cast("int"))
    decision = F.when(conv % 3 == 0, "accept").when(conv % 3 == 1, "reject")
    rows = adapters.table(spark, sf_dir, "conversations").where("turn < 7")
    return rows.select(
        F.format_string("batch%02d", conv % BATCHES).alias("batch_id"), F.concat(F.lit("s"), F.floor(conv / SHARED)).alias("sample"), conv.alias("job_id"),
        decision.alias("decision"), (conv % 10 / 10).alias("score"), kind.alias("kind"), F.encode("text", "UTF-8").alias("content"),
    )


def _written(spark: SparkSession, sf_dir: str) -> str:
    folder = shared.new_folder(spark, "archives")
    A.write_archives(_files(spark, sf_dir), folder, {"prompt": "turns"}, most_bytes=100_000)
    return folder


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.read_archives(spark, _written(spark, sf_dir)).where("name != 'dataset.json'")
    return rows.select("batch_id", "name", "size", F.md5("content").alias("md5"))


def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives' own indexes say, over all archives of a batch."""
    text = F.decode("content", "UTF-8")
    count = lambda c: F.sum(F.get_json_object(text, f"$.counts.{c}").cast("long")).alias(c)
    return A.read_archives(spark, _written(spark, sf_dir)).where("name = 'dataset.json'").groupBy("batch_id").agg(count("samples"), count("accepted"), count("rejected"))


NAMES = [archive_members, archive_counts]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


FILES_SQL = f"""WITH f AS (SELECT printf('batch%02d', conv_id % {BATCHES}) AS batch_id, 's' || (conv_id // {SHARED}) AS sample, conv_id, ({list(A.KINDS)})[(turn + conv_id) % 7 + 1] AS kind, text FROM conversations WHERE turn < 7 AND text IS NOT NULL),
m AS (SELECT DISTINCT batch_id, conv_id FROM f WHERE kind IN {A.GENERATED}), r AS (SELECT f.* FROM f JOIN m USING (batch_id, conv_id))"""


def oracle_sql() -> dict[str, str]:
    names = "(" + str({k: v for k, v in A.KINDS.items()}).replace("{", "MAP {") + ")[kind]"
    return {
        "archive_members": FILES_SQL
        + f""", n AS (SELECT *, {names} AS file, row_number() OVER (PARTITION BY batch_id, sample, kind ORDER BY CAST(conv_id AS VARCHAR)) AS k FROM r)
            SELECT batch_id, 'samples/' || sample || '/' || CASE WHEN k = 1 THEN file ELSE split_part(file, '.', 1) || '_' || k || '.' || split_part(file, '.', 2) END AS name, octet_length(encode(text)) AS size, md5(text) AS md5 FROM n""",
        "archive_counts": FILES_SQL
        + " SELECT batch_id, count(DISTINCT conv_id) AS samples, count(DISTINCT conv_id) FILTER (conv_id % 3 = 0) AS accepted, count(DISTINCT conv_id) FILTER (conv_id % 3 <> 0) AS rejected FROM r GROUP BY 1",
    }
