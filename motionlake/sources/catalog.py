"""Folders of runs, videos, sessions and jobs as tables.

A document that can't be parsed is a row with an error, and a missing one is a null: nothing here fails on single files.
Listings come from file metadata, documents from one scan of all files of a kind, and joins bring them together, so no
folder is walked on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import list_files, prefer

# The kinds of sources of a dataset catalog.
METHODS = ["direct_url", "huggingface", "youtube"]

MANIFEST = "run_id string, kind string, decision string, plausibility_score double"
SESSION = "session_id string, cameras array<string>, tier string"
SYNC = "method string, confidence double, cameras array<struct<cam_id:string,offset_s:double>>"
CALIBRATION = "method string, confidence double"
REPROJECTION = "mean_reproj_error_px double, p95_reproj_error_px double, n_frames long, per_frame array<struct<frame:long,reproj_error_px:double>>"
JOB = "job_id string, user_prompt string, variants array<struct<variant_id:string,event_id:string,cam_id:string,prompt:string>>"
RECORD = "verdict string, verdict_reasons array<string>, vlm struct<judge_source:string,confidence:double>, labels struct<skills:array<string>>"
TRANSCRIPT = "transcript array<struct<action:string,args:struct<name:string>>>, llm_stats array<struct<provider:string>>"


def documents(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """path (relative to the folder), doc (null if it isn't the JSON that was asked for) and error, one row a file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = files.select(relative(F.col("_metadata.file_path"), folder).alias("path"), F.from_json("value", schema).alias("doc"), F.try_parse_json("value").isNull().alias("bad"))
    return rows.select("path", F.when(~F.col("bad"), F.col("doc")).alias("doc"), F.when(F.col("bad"), F.lit("invalid_json")).alias("error"))


def relative(path: Column, folder: str) -> Column:
    root = folder.removeprefix("file:").rstrip("/") + "/"
    return F.url_decode(F.regexp_replace(F.substring_index(path, root, -1), "^/+", ""))


def part(path: str, i: int) -> Column:
    """The i-th folder of a relative path."""
    return F.get(F.split(path, "/"), F.lit(i))


def listing(spark: SparkSession, folder: str, pattern: str = "*", base_url: str = "") -> DataFrame:
    """path (relative), name, size and url of all files below a folder."""
    rows = list_files(spark, folder, pattern).withColumn("path", relative(F.col("path"), folder))
    return rows.select("path", "name", "size", F.concat(F.lit(base_url.rstrip("/") + "/"), "path").alias("url"))


def files_by_run(files: DataFrame) -> DataFrame:
    """run and files: a map from each relative path below the run to its url and size, in order of path."""
    below = F.array_join(F.slice(F.split("path", "/"), 2, 1000), "/")
    entry = F.struct(below.alias("key"), F.struct("url", F.col("size").alias("size_bytes")).alias("value"))
    return files.groupBy(part("path", 0).alias("run")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))


def runs(spark: SparkSession, folder: str, base_url: str = "") -> DataFrame:
    """A row a run: its url, its manifest's kind, decision and score, or manifest_error; runs without a manifest stay."""
    found = listing(spark, folder).select(part("path", 0).alias("run")).distinct()
    told = documents(spark, folder, "manifest.json", MANIFEST).where(F.size(F.split("path", "/")) == 2).select(part("path", 0).alias("run"), F.col("doc.kind").alias("kind"), F.col("doc.decision").alias("decision"), "doc.plausibility_score", F.col("error").alias("manifest_error"), F.lit(True).alias("has_manifest"))
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), "run")
    rows = found.join(told, "run", "left").withColumns({"url": url, "manifest_url": F.when(F.col("has_manifest"), F.concat(url, F.lit("/manifest.json")))})
    return rows.drop("has_manifest")


def run_or_listing(spark: SparkSession, folder: str, run: str, base_url: str = "") -> DataFrame:
    """One run: its manifest, or where it has none, its files."""
    told = runs(spark, folder, base_url).where(F.col("run") == run)
    return told.join(files_by_run(listing(spark, folder, base_url=base_url)), "run", "left").withColumn("files", F.when(F.col("manifest_url").isNull(), F.col("files")))


def videos(raw: DataFrame, samples: DataFrame, sources: DataFrame, series: DataFrame) -> DataFrame:
    """Videos of both roots with their subject and whether a series of them exists.

    raw: path (source/name), size; samples: path (name), size; sources: source_id, subject; series: subject, stem. A raw video's
    subject is its source's, else told by the source's name; that of a sample is told by its own.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    own = raw.where(~F.col("path").rlike(r"(^|/)\.")).select(part("path", 0).alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "size", F.concat(F.lit("/media/raw/"), "path").alias("url"))
    own = own.join(sources.select("source_id", F.col("subject").alias("known")), "source_id", "left").withColumn("subject", F.coalesce("known", F.when(F.contains("source_id", F.lit("animal")), "animal").otherwise("human"))).drop("known")
    more = samples.select(F.lit("cc_samples").alias("source_id"), F.col("path").alias("filename"), "size", F.concat(F.lit("/media/demo/"), "path").alias("url"), F.when(F.startswith("path", F.lit("human")), "human").otherwise("animal").alias("subject"))
    rows = own.unionByName(more).withColumn("stem", stem)
    has = series.select("subject", "stem", F.lit(True).alias("has_timeseries")).distinct()
    return rows.join(has, ["subject", "stem"], "left").select(F.concat_ws("/", "source_id", "filename").alias("id"), "source_id", "filename", "stem", "subject", F.round(F.col("size") / 1e6, 2).alias("size_mb"), "url", F.coalesce("has_timeseries", F.lit(False)).alias("has_timeseries"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions (folders with a session.json) with their synchronisation, calibration and mean reprojection error by frame."""
    kind = lambda name, schema: documents(spark, folder, name, schema).select(part("path", 0).alias("session"), F.col("doc"))
    meta = kind("session.json", SESSION).select("session", F.coalesce("doc.session_id", "session").alias("session_id"), F.coalesce("doc.cameras", F.array().cast("array<string>")).alias("cameras"), F.coalesce("doc.tier", F.lit("multiview_gt")).alias("tier"))
    rows = meta.join(kind("sync.json", SYNC).withColumnRenamed("doc", "sync"), "session", "left").join(kind("calibration.json", CALIBRATION).withColumnRenamed("doc", "calibration"), "session", "left")
    reproj = kind("cross_view_reproj.json", REPROJECTION)
    errors = frame_means(reproj.select("session", F.explode("doc.per_frame").alias("f")).select("session", "f.frame", "f.reproj_error_px"), "session")
    per = errors.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("frame", "mean_error_px"))).alias("per_frame"))
    return rows.join(reproj.select("session", "doc.mean_reproj_error_px", "doc.p95_reproj_error_px", "doc.n_frames"), "session", "left").join(per, "session", "left")


def frame_means(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "frame").agg(F.round(F.avg("reproj_error_px"), 3).alias("mean_error_px"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs (folders with a spec.json) with their variants: prompt, whether there is a video, and the verification's verdict."""
    spec = documents(spark, folder, "spec.json", JOB).where("doc IS NOT NULL").select(part("path", 0).alias("job"), "doc")
    each = spec.select("job", F.posexplode("doc.variants").alias("i", "v")).select("job", "i", "v.*").withColumn("prompt", F.left("prompt", F.lit(400)))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    checked = documents(spark, folder, "*.json", RECORD).where(part("path", 1) == "verification").select(part("path", 0).alias("job"), stem.alias("variant_id"), "doc.verdict", "doc.verdict_reasons", F.col("doc.vlm.judge_source").alias("judge"), F.col("doc.labels.skills").alias("skills"))
    made = listing(spark, folder, "*.mp4").where(part("path", 1) == "videos").select(part("path", 0).alias("job"), stem.alias("variant_id"), F.lit(True).alias("generated"))
    rows = each.join(checked, ["job", "variant_id"], "left").join(made, ["job", "variant_id"], "left").withColumn("generated", F.coalesce("generated", F.lit(False)))
    one = rows.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("i", "variant_id", "event_id", "cam_id", "prompt", "generated", "verdict", "verdict_reasons", "judge", "skills"))).alias("variants"))
    return spec.select("job", F.col("doc.user_prompt").alias("prompt")).join(one, "job", "left")


def restored_jobs(videos: DataFrame, reports: DataFrame, scenarios: DataFrame) -> DataFrame:
    """A batch's jobs from what is on disk.

    videos: job, name. reports: job, video_id, decision, plausible, score, reason. scenarios: scenario_id, title. Job folders
    without a video are left out; a job's scenario is the one its report names, else the one its video is named after.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    labelled = F.endswith(stem, F.lit("_labeled"))
    one = videos.groupBy("job").agg(F.min(F.when(~labelled, F.col("name"))).alias("raw"), F.min(F.when(labelled, F.col("name"))).alias("labeled"))
    named = F.regexp_replace(F.regexp_replace(F.coalesce("raw", "labeled"), r"\.[^.]*$", ""), "_labeled", "")
    rows = one.join(reports, "job", "left").withColumn("scenario_id", F.coalesce(F.nullif("video_id", F.lit("")), named)).join(scenarios, "scenario_id", "left")
    decision = F.lower(F.coalesce("decision", F.lit("accept")))
    accepted = F.coalesce("plausible", decision != "reject") & ~decision.isin("reject", "rejected")
    return rows.select(
        "job", "scenario_id", F.coalesce("title", "scenario_id").alias("title"), F.col("raw").alias("video"), F.col("labeled").alias("labeled_video"), F.when(accepted, "completed").otherwise("failed").alias("status"),
        F.when(accepted, "passed").otherwise("rejected").alias("review_status"), F.when(~accepted, F.coalesce("reason", F.lit("Rejected by verifier."))).alias("error"), "score",
    )


def sources_of(catalog: DataFrame, subject: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Rows of a dataset catalog (source_id, subject, method, ...) of a known method, of one subject or some ids."""
    rows = catalog.where(F.col("method").isin(METHODS))
    rows = rows.where(F.col("subject") == subject) if subject else rows
    return rows.where(F.col("source_id").isin(ids)) if ids else rows


def import_manifest(results: DataFrame) -> DataFrame:
    """Totals of imports by source: files, errors and bytes; results: source_id, subject, path, size, error."""
    return results.groupBy("source_id", "subject").agg(F.count_if(F.col("error").isNull()).alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def predictions(segments: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Predictions of a benchmark: clips that have both documents."""
    return segments.join(reports, key)


def with_constants(found: DataFrame, constants: DataFrame, key: str, only_if_empty: bool = False) -> DataFrame:
    """Rows that were found and fixed ones behind them, marked mock; or the fixed ones only where none were found."""
    real = found.withColumn("mock", F.lit(False))
    if only_if_empty:
        constants = constants.join(real.select(F.lit(1).alias("__one")).limit(1), F.lit(True), "left_anti")
    return prefer(real, constants.withColumn("mock", F.lit(True)), key)


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """What agents did in each run: the sequence of actions, the number of steps, and calls by provider."""
    rows = documents(spark, folder, "agentic_transcript.json", TRANSCRIPT).select(part("path", 0).alias("run"), "doc")
    said = F.transform("doc.transcript", lambda s: F.when(s["action"] == "run_tool", F.coalesce(s["args"]["name"], F.lit("?"))).when(s["action"].isin("look", "video_analysis", "note"), s["action"]).when(s["action"] == "finalize", "FIN").when(s["action"] == "parse_error", "(perr)"))
    return rows.select("run", F.array_compact(said).alias("actions"), F.size("doc.transcript").alias("n_steps"), F.transform("doc.llm_stats", lambda s: s["provider"]).alias("providers"))


def provider_counts(rows: DataFrame, key: str = "run") -> DataFrame:
    return rows.select(key, F.explode("providers").alias("provider")).groupBy(key, "provider").agg(F.count("*").alias("n"))


def yaml_rows(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """path and the rows of each configuration's list under key; a file is parsed whole by the task that reads it. Files that are no
    YAML, or have no such list, have no rows; values of another type than the schema's are null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in parts:
            out = []
            for name, text in zip(part["path"], part["value"], strict=True):
                try:
                    found = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                rows = found.get(key) if isinstance(found, dict) else None
                out += [(name, json.dumps(r, default=str)) for r in (rows if isinstance(rows, list) else [])]
            yield pd.DataFrame(out, columns=["path", "entry"], dtype="object")

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, "path string, entry string").select("path", F.from_json("entry", schema).alias("r")).select("path", "r.*")
