"""Counts and rates over runs, manifests, verdicts and label benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A manifest's status that lets an episode pass a stage.
PASSED = ("success", "skipped")


def is_success() -> Column:
    """A run that neither failed nor was rejected in review."""
    return (F.col("status") != "failed") & (F.coalesce("review_status", F.lit("")) != "failed")


def has_dataset() -> Column:
    return (F.col("zones") > 0) | F.coalesce(F.col("label_status") == "completed", F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    """Whole percent, half up; null of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).cast("long")


def kpis(runs: DataFrame, *keys: str) -> DataFrame:
    """The block of key figures, of all runs or of each group."""
    reviewed, passed = F.count_if(F.col("review_status").isin("passed", "failed")), F.count_if(F.col("review_status") == "passed")
    return runs.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(is_success()).alias("succeeded"),
        F.count_if(has_dataset()).alias("datasets"),
        rate(F.count_if(is_success()), F.count("*")).alias("success_rate"),
        F.round(F.avg("seconds"), 4).alias("avg_seconds"),
        F.coalesce(F.sum("zones"), F.lit(0)).alias("zones"),
        rate(passed, reviewed).alias("validation_rate"),
        F.count_if(F.col("review_status") == "failed").alias("validation_failed"),
    )


def daily_timeline(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("day", F.lit("unknown")).alias("day")).agg(F.count("*").alias("videos"), F.count_if(has_dataset()).alias("datasets"))


def latency(runs: DataFrame, key: str) -> DataFrame:
    """Mean seconds of each group that has any, to a tenth."""
    return runs.groupBy(key).agg(F.avg("seconds").alias("s")).where("s IS NOT NULL").select(key, (F.floor(F.col("s") * 10 + 0.5) / 10).alias("seconds"))


def outcome_split(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.when(is_success(), "succeeded").otherwise("failed").alias("name")).agg(F.count("*").alias("value"))


def recent(runs: DataFrame, n: int = 8) -> DataFrame:
    return runs.orderBy(F.desc("day"), F.desc("id")).limit(n)


def acceptance_funnel(runs: DataFrame) -> DataFrame:
    """Five independent counts, and three reasons of failure."""
    review_failed, label_failed = F.coalesce(F.col("review_status") == "failed", F.lit(False)), F.coalesce(F.col("label_status") == "failed", F.lit(False))
    return runs.agg(
        F.count("*").alias("generated"),
        F.count_if(F.col("review_status").isNotNull()).alias("reviewed"),
        F.count_if(F.col("review_status") == "passed").alias("validated"),
        F.count_if(F.col("label_status") == "completed").alias("labelled"),
        F.count_if((F.col("label_status") == "completed") & (F.col("status") == "completed")).alias("committed"),
        F.count_if(review_failed).alias("failed_validation"),
        F.count_if((F.col("status") == "failed") & ~review_failed).alias("failed_generation"),
        F.count_if(label_failed).alias("failed_labelling"),
    )


def throughput(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs a minute of the seconds spent; 0 where none were."""
    spent = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return runs.groupBy(*keys).agg(F.round(F.when(spent > 0, F.count("*") / spent * 60).otherwise(0.0), 6).alias("per_minute"))


def stage_funnel(manifests: DataFrame, stages: list[str]) -> DataFrame:
    """How many episodes pass each stage, counted stage by stage; a missing manifest is pending."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    seen = manifests.groupBy("stage").agg(
        F.count_if(F.col("status").isin(*PASSED)).alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("n")
    )
    total = manifests.agg(F.count_distinct("episode_id").alias("episodes"))
    frame = total.select("episodes", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return frame.join(seen, "stage", "left").select("stage", F.element_at(order, F.col("stage")).alias("place"), zero("passed").alias("passed"), zero("failed").alias("failed"), (F.col("episodes") - zero("n")).alias("pending"))


def histogram(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of the fixed values, with zeros."""
    one = rows.agg(*[F.count_if(F.col(key) == v).alias(v) for v in values])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias(key), F.col(v).alias("n")) for v in values])).alias("x")).select("x.*")


def batch_status(runs: DataFrame) -> DataFrame:
    """Counters, progress and end state of each batch."""
    done = F.col("completed") + F.col("failed")
    state = F.when(done < F.col("total"), "running").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    counts = runs.groupBy("batch").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.withColumns({"progress": F.least(F.lit(100), F.floor(done / F.col("total") * 100 + 0.5)).cast("long"), "state": state})


def batch_decision(runs: DataFrame, all_must_pass: bool = True) -> DataFrame:
    """A batch is accepted if it isn't empty and, where asked for, none of its runs was rejected or failed."""
    bad = F.count_if(~is_success())
    return runs.groupBy("batch").agg(bad.alias("rejected"), ((F.count("*") > 0) & ((bad == 0) if all_must_pass else F.lit(True))).alias("accepted"))


def mode_per_group(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.k")).alias("n"))


def class_presence(rows: DataFrame, key: str, t: str, most: int = 60) -> DataFrame:
    """Count of each class and the distinct seconds in which it shows, the first ``most`` of them."""
    one = rows.groupBy(key, F.floor(t).cast("long").alias("s")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("s")
    ranked = one.withColumn("place", F.row_number().over(w))
    first = F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.col("s"))))
    return ranked.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("n_seconds"), first.alias("seconds"))


def weighted_corr(rows: DataFrame, keys: list[str], a: str, b: str, w: str) -> DataFrame:
    """Weighted Pearson correlation; 0 where a side is flat."""
    s = rows.groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(F.col(w) * F.col(a)).alias("wa"), F.sum(F.col(w) * F.col(b)).alias("wb"),
        F.sum(F.col(w) * F.col(a) * F.col(a)).alias("waa"), F.sum(F.col(w) * F.col(b) * F.col(b)).alias("wbb"), F.sum(F.col(w) * F.col(a) * F.col(b)).alias("wab"),
    )
    cov = F.col("wab") / F.col("w") - F.col("wa") / F.col("w") * F.col("wb") / F.col("w")
    va, vb = (F.col(f"w{c}{c}") / F.col("w") - F.pow(F.col(f"w{c}") / F.col("w"), F.lit(2.0)) for c in "ab")
    return s.select(*keys, F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb)).otherwise(0.0).alias("corr"))


def residuals(rows: DataFrame, keys: list[str], error: str) -> DataFrame:
    """n, mean, 95th percentile and largest error."""
    return rows.groupBy(*keys).agg(F.count(error).alias("n"), F.avg(error).alias("mean"), F.percentile(error, F.lit(0.95)).alias("p95"), F.max(error).alias("max"))


def spend(rows: DataFrame, key: str, limit: int = 4) -> DataFrame:
    """Attempts and seconds of each group; attempts above the limit are over budget."""
    return rows.groupBy(key).agg(F.count("*").alias("clips"), F.sum("attempts").alias("attempts"), F.round(F.sum("seconds"), 4).alias("seconds"), F.count_if(F.col("attempts") > limit).alias("over_budget"))


def sessions(rows: DataFrame, event: str, camera: str, least: int = 2) -> DataFrame:
    """Accepted rows by event; events that ``least`` cameras saw are sessions."""
    return rows.groupBy(event).agg(F.count_distinct(camera).alias("cameras"), F.count("*").alias("n")).where(F.col("cameras") >= least)


def merge_verdict(model: Column, notes: Column, physics: Column) -> Column:
    """verdict and reasons of a clip.

    model: what the reviewing model recommends (proceed, human_review or reject), notes: what it says of a rejection,
    physics: array of the physics checks' reasons. Two reasons, or one that tells of a video that can't be read, reject
    like the model does; a single one, or the model's doubt, leaves the clip to review.
    """
    found = F.coalesce(physics, F.array().cast("array<string>"))
    unread = F.exists(found, lambda r: F.contains(r, F.lit("decodable")) | F.contains(r, F.lit("open video")))
    rejects, doubts = F.coalesce(model == "reject", F.lit(False)), F.coalesce(model == "human_review", F.lit(False))
    said = F.when(rejects, F.concat(F.lit("vlm: reject ("), F.coalesce(F.nullif(notes, F.lit("")), F.lit("unspecified")), F.lit(")"))).when(doubts, "vlm: human_review")
    reasons = F.concat(F.array_compact(F.array(said)), F.transform(found, lambda r: F.concat(F.lit("physics: "), r)))
    verdict = F.when(rejects | (F.size(found) >= 2) | unread, "reject").when(doubts | (F.size(found) == 1), "review").otherwise("accept")
    return F.struct(verdict.alias("verdict"), F.when(F.size(reasons) == 0, F.array(F.lit("both tracks passed"))).otherwise(reasons).alias("reasons"))


def score_clips(truth: DataFrame, predicted: DataFrame, segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Scores of each clip's labels.

    truth: clip, verdicts, humans, expected, allowed, forbidden (arrays); predicted: clip, recommendation, human;
    segments: clip, start_s, end_s, skill, evidence; keys: clip, skills (array), start_s, end_s.
    """
    action = F.col("skill") != "idle"
    told = segments.groupBy("clip").agg(
        F.collect_set("skill").alias("skills"),
        F.collect_set(F.when(action, F.col("skill"))).alias("actions"),
        F.count_if(action).alias("n_actions"),
        F.count_if(action & (F.trim(F.coalesce("evidence", F.lit(""))) != "")).alias("n_evidence"),
    )
    held = keys.withColumn("k", F.monotonically_increasing_id()).select("clip", "k", "skills", F.col("start_s").alias("k0"), F.col("end_s").alias("k1"))
    hits = held.join(segments.select("clip", "skill", "start_s", "end_s"), "clip", "left").groupBy("clip", "k", "k0", "k1").agg(
        F.min(F.when(F.array_contains("skills", F.col("skill")), F.col("start_s"))).alias("m0"), F.max(F.when(F.array_contains("skills", F.col("skill")), F.col("end_s"))).alias("m1")
    )
    hull = F.greatest("k1", "m1") - F.least("k0", "m0")
    iou = F.when(F.col("m0").isNull(), 0.0).when(hull > 1e-9, F.greatest(F.lit(0.0), F.least("k1", "m1") - F.greatest("k0", "m0")) / hull).otherwise(0.0)
    mae = F.when(F.col("m0").isNotNull(), (F.abs(F.col("m0") - F.col("k0")) + F.abs(F.col("m1") - F.col("k1"))) / 2)
    bounds = hits.groupBy("clip").agg(F.avg(iou).alias("iou"), F.avg(mae).alias("mae"))
    none = F.array().cast("array<string>")
    rows = truth.join(predicted, "clip", "left").join(told, "clip", "left").join(bounds, "clip", "left").withColumns({c: F.coalesce(c, none) for c in ("skills", "actions", "expected", "allowed", "forbidden")})
    negative, idle = F.size("expected") == 0, F.size("actions") == 0
    recall = F.when(negative, idle).otherwise(F.arrays_overlap("expected", "skills"))
    precision = F.when(idle, F.when(negative, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect("actions", F.array_union("allowed", F.array(F.lit("idle"))))) / F.greatest(F.size("actions"), F.lit(1)))
    return rows.select(
        "clip",
        F.coalesce(F.array_contains("verdicts", F.col("recommendation")), F.lit(False)).alias("verdict_ok"),
        F.coalesce(F.array_contains("humans", F.col("human")), F.lit(False)).alias("human_ok"),
        recall.alias("skill_recall"),
        F.round(precision, 3).alias("skill_precision"),
        F.array_sort(F.array_intersect("skills", "forbidden")).alias("hallucinations"),
        F.round("iou", 3).alias("boundary_iou"),
        F.round("mae", 2).alias("boundary_mae_s"),
        F.round(F.when(F.col("n_actions") > 0, F.col("n_evidence") / F.col("n_actions")), 2).alias("evidence_coverage"),
    )


def aggregate_scores(clips: DataFrame) -> DataFrame:
    """Means over clips; what a clip lacks isn't averaged."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 3)
    return clips.agg(
        F.count("*").alias("n_clips"),
        share("verdict_ok").alias("verdict_accuracy"),
        share("human_ok").alias("human_accuracy"),
        share("skill_recall").alias("skill_recall"),
        F.round(F.avg("skill_precision"), 3).alias("skill_precision_mean"),
        F.count_if(F.size("hallucinations") > 0).alias("clips_with_hallucinations"),
        F.round(F.avg("boundary_iou"), 3).alias("boundary_iou_mean"),
        F.round(F.avg("boundary_mae_s"), 2).alias("boundary_mae_s_mean"),
        F.round(F.avg("evidence_coverage"), 2).alias("evidence_coverage_mean"),
    )
