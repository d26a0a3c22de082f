"""Episodes as a whole: their quality decision, the report of their stages, and the funnel of all of them.

manifests: key, stage, status, metric (the first metric as text, null if the stage has none). A row a stage; of several the least by
status counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages whose gates a decision takes, stages of a report and of the funnel, the funnel that is shown where nothing was
# run, how many reasons a failure names, and the signs of what isn't there.
GATED = ["ingest", "feasibility_judge", "geometry", "human_body", "hands", "objects"]
REPORTED = ["ingest", "feasibility_judge", "geometry", "human_body", "hands", "objects", "contact", "semantics", "retarget", "physics_validate", "qa", "package"]
REASONS, NOTHING, PENDING = 3, "—", "pending"


def one_per_stage(manifests: DataFrame, key: str) -> DataFrame:
    return manifests.groupBy(key, "stage").agg(F.min(F.struct("status", "metric")).alias("m")).select(key, "stage", "m.status", "m.metric")


def decisions(manifests: DataFrame, crosschecks: DataFrame, key: str) -> DataFrame:
    """key, accepted, gates (those that stages with metrics have), failed_gates, failure_stage and failure_reason of each episode
    that was cross-checked (key, passed, reasons): accepted if its cross-checks and all of its gates pass."""
    gated = one_per_stage(manifests, key).where(F.col("stage").isin(GATED) & F.col("metric").isNotNull())
    gates = gated.groupBy(key).agg(F.count("*").alias("gates"), F.array_sort(F.collect_list(F.when(F.col("status") != "success", F.col("stage")))).alias("failed"))
    rows = crosschecks.select(key, "passed", "reasons").join(gates, key, "left")
    failed = F.coalesce("failed", F.array().cast("array<string>"))
    accepted = F.coalesce("passed", F.lit(False)) & (F.size(failed) == 0)
    reason = F.array_join(F.slice(F.coalesce("reasons", F.array().cast("array<string>")), 1, REASONS), "; ")
    return rows.select(
        key, accepted.alias("accepted"), F.coalesce("gates", F.lit(0)).cast("long").alias("gates"), F.array_join(failed, ",").alias("failed_gates"), F.when(~accepted, "qa").alias("failure_stage"), F.when(~accepted, reason).alias("failure_reason")
    )


def job_funnel(manifests: DataFrame, key: str, stages: list[str], mock: list[int]) -> DataFrame:
    """stage, place, count (episodes whose stage succeeded or was skipped, counted stage by stage), total and mock. Where there are no
    manifests at all, the counts of the mock."""
    seen = one_per_stage(manifests, key)
    passed = F.col("status").isin("success", "skipped")
    one = seen.agg(F.count_distinct(key).alias("total"), *[F.count_if(passed & (F.col("stage") == s)).alias(f"n{i}") for i, s in enumerate(stages)])
    count = lambda i: F.when(F.col("total") > 0, F.col(f"n{i}")).otherwise(F.lit(mock[i]))
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("place"), count(i).cast("long").alias("count")) for i, s in enumerate(stages)])
    return one.select(F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(mock[0])).cast("long").alias("total"), (F.col("total") == 0).alias("mock"), F.inline(rows)).select("stage", "place", "count", "total", "mock")


def lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def stage_reports(manifests: DataFrame, feasibility: DataFrame, physics: DataFrame, key: str, robots: list[str]) -> DataFrame:
    """key and report: the Markdown of each episode's stages, its feasibility, if it was judged, and its robots.

    feasibility: key, recommendation, confidence, violation_ratio, plausible, judge, artifacts (array). physics: key, robot, valid.
    Episodes are those that have manifests.
    """
    entry = F.struct("stage", F.struct("status", F.coalesce("metric", F.lit(NOTHING)).alias("metric")).alias("m"))
    rows = one_per_stage(manifests, key).groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("stages"))
    valid = physics.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("robot", F.col("valid").cast("string").alias("v"))))).alias("valid"))
    rows = rows.join(feasibility.withColumn("judged", F.lit(True)), key, "left").join(valid, key, "left")
    of = lambda m, name: F.try_element_at(m, F.lit(name))
    stage = [lines(f"| {s} | ", F.coalesce(of("stages", s)["status"], F.lit(PENDING)), " | ", F.coalesce(of("stages", s)["metric"], F.lit(NOTHING)), " |\n") for s in REPORTED]
    judged = lines(
        "\n## Feasibility gate (pre-analysis QA)\n\n- recommendation: **", F.col("recommendation"), "**\n- confidence: ", F.format_string("%.2f", "confidence"), "\n- physics_violation_frame_ratio: ", F.format_string("%.3f", "violation_ratio"),
        "\n- physically_plausible: ", F.initcap(F.col("plausible").cast("string")), "\n- judge_source: ", F.col("judge"), "\n", F.when(F.size("artifacts") > 0, lines("- ai_artifacts: ", F.array_join("artifacts", ", "), "\n")).otherwise(""),
    )
    retarget = F.coalesce(of("stages", "retarget")["status"], F.lit(NOTHING))
    robot = [lines(f"- **{r}**: retarget=", retarget, ", physics_valid=", F.coalesce(F.initcap(of("valid", r)), F.lit(NOTHING)), "\n") for r in robots]
    head = lines("# Yield Report — ", F.col(key).cast("string"), "\n\n| Stage | Status | Key metric |\n|-------|--------|------------|\n")
    report = lines(head, *stage, F.when(F.col("judged"), judged).otherwise(""), "\n## Retarget / physics by robot\n\n", *robot)
    return rows.select(key, report.alias("report"))
