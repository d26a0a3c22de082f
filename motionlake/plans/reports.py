"""Queries of key figures, funnels, verdicts and label benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import rollups as R

SKILLS = ["reach", "grasp", "lift", "place"]


def kpi_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kpis(adapters.runs(spark, sf_dir))


def kpi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures by camera and status, with subtotals."""
    return adapters.runs(spark, sf_dir).rollup("camera", "status").agg(F.count("*").alias("total"), F.sum("zones").alias("zones"), F.round(F.avg("seconds"), 4).alias("avg_seconds"))


def daily_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_timeline(adapters.runs(spark, sf_dir))


def latency_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latency(adapters.runs(spark, sf_dir), "camera")


def outcome_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcome_split(adapters.runs(spark, sf_dir))


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(adapters.runs(spark, sf_dir)).select("id", "day", "status", "zones")


def acceptance_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.acceptance_funnel(adapters.runs(spark, sf_dir))


def throughput_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.throughput(adapters.runs(spark, sf_dir), "camera")


def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage_funnel(adapters.manifests(spark, sf_dir), [*adapters.LINE_STAGES, "report"])


def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(_verdicts(spark, sf_dir), "verdict", ["accept", "review", "reject", "error"])


def _verdicts(spark, sf_dir):
    model = F.when(F.col("status") == "completed", "proceed").when(F.col("status") == "failed", "reject").otherwise("human_review")
    reasons = F.array_compact(F.array(F.when(F.col("zones") == 0, "video not decodable"), F.when(F.col("zones") % 3 == 1, "flow spikes"), F.when(F.col("zones") % 4 == 1, "scale jumps")))
    return adapters.runs(spark, sf_dir).select("id", R.merge_verdict(model, F.when(F.col("batch") % 2 == 0, F.lit("extra fingers")), reasons).alias("m")).select("id", "m.verdict", F.array_join("m.reasons", "; ").alias("reasons"))


def merge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_status(adapters.runs(spark, sf_dir))


def batch_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_decision(adapters.runs(spark, sf_dir))


def mode_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_per_group(adapters.table(spark, sf_dir, "events"), ["user_id"], "event_type")


def class_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.series(spark, sf_dir).withColumn("hour", F.col("t") / 3600)
    found = R.class_presence(rows, "event_type", "hour", 20)
    return found.select("event_type", "n", "n_seconds", F.array_join(F.transform("seconds", lambda x: x.cast("string")), ",").alias("seconds"))


def weighted_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.table(spark, sf_dir, "lineitem")
    return R.weighted_corr(items, ["l_returnflag"], "l_quantity", "l_extendedprice", "l_discount").select("l_returnflag", F.round("corr", 6).alias("corr"))


def p95_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem").withColumn("error", F.abs(F.col("l_extendedprice") / F.col("l_quantity") - 2000))
    return R.residuals(rows, ["l_linenumber"], "error").select("l_linenumber", "n", *[F.round(c, 1).alias(c) for c in ("mean", "p95", "max")])


def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spend(adapters.runs(spark, sf_dir).select("camera", F.col("zones").alias("attempts"), "seconds"), "camera")


def sessions_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions(adapters.runs(spark, sf_dir).where(R.is_success()), "batch", "camera", 4)


def _bench(spark, sf_dir):
    """Orders as clips: the customer says what is expected, the items are the predicted segments."""
    orders = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    skill = lambda n: F.element_at(F.array(*[F.lit(x) for x in SKILLS]), (n % 4).cast("int") + 1)
    none = F.array().cast("array<string>")
    truth = orders.select(
        "clip",
        F.when(F.col("c") % 5 == 0, F.array(F.lit("R"))).otherwise(F.array(F.lit("F"), F.lit("O"))).alias("verdicts"),
        F.array(F.when(F.col("c") % 2 == 0, "yes").otherwise("no")).alias("humans"),
        F.when(F.col("c") % 7 == 0, none).otherwise(F.array(skill(F.col("c")))).alias("expected"),
        F.array(skill(F.col("c")), skill(F.col("c") + 1)).alias("allowed"),
        F.array(skill(F.col("c") + 2)).alias("forbidden"),
    )
    predicted = orders.select("clip", F.col("s").alias("recommendation"), F.when(F.col("clip") % 3 == 0, "yes").otherwise("no").alias("human"))
    items = adapters.table(spark, sf_dir, "lineitem")
    seg = items.select(
        F.col("l_orderkey").alias("clip"), (F.col("l_linenumber") * 10.0).alias("start_s"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("end_s"),
        F.when(F.col("l_returnflag") == "N", "idle").otherwise(skill(F.col("l_partkey"))).alias("skill"), F.when(F.col("l_suppkey") % 2 == 0, "seen").alias("evidence"),
    )
    keys = orders.where("c % 7 != 0").select("clip", F.array(skill(F.col("c"))).alias("skills"), F.lit(15.0).alias("start_s"), F.lit(45.0).alias("end_s"))
    return R.score_clips(truth, predicted, seg, keys)


def bench_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).withColumn("hallucinations", F.array_join("hallucinations", ","))


def bench_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aggregate_scores(_bench(spark, sf_dir))


NAMES = [
    kpi_block, kpi_rollup, daily_timeline, latency_by_stage, outcome_split, recent_runs, acceptance_funnel, throughput_rate, stage_funnel, verdict_histogram, merge_verdict, batch_status, batch_decision,
    mode_per_group, class_presence, weighted_corr, p95_residuals, spend_rollup, sessions_by_event, bench_clip, bench_aggregate,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


RUNS_SQL = """WITH runs AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey AS batch, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
    CASE o_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN NULL ELSE 'passed' END AS review_status,
    CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'completed' WHEN o_custkey % 3 = 1 THEN 'failed' END AS label_status,
    o_orderpriority AS camera, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 1000 END AS seconds, coalesce(z.n, 0) AS zones
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) z ON l_orderkey = o_orderkey),
ok AS (SELECT *, status <> 'failed' AND coalesce(review_status, '') <> 'failed' AS good, zones > 0 OR coalesce(label_status = 'completed', false) AS ds FROM runs)
"""
# Two reasons of physics, or a video that can't be decoded, reject; one, or the model's doubt, is reviewed.
PHYSICS = "(CAST(zones = 0 AS INTEGER) + CAST(zones % 3 = 1 AS INTEGER) + CAST(zones % 4 = 1 AS INTEGER))"
VERDICT = f"CASE WHEN status = 'failed' OR zones = 0 OR {PHYSICS} >= 2 THEN 'reject' WHEN status = 'running' OR {PHYSICS} = 1 THEN 'review' ELSE 'accept' END"
REASONS = """coalesce(nullif(concat_ws('; ', CASE status WHEN 'failed' THEN 'vlm: reject (' || CASE WHEN batch % 2 = 0 THEN 'extra fingers' ELSE 'unspecified' END || ')' WHEN 'running' THEN 'vlm: human_review' END,
  CASE WHEN zones = 0 THEN 'physics: video not decodable' END, CASE WHEN zones % 3 = 1 THEN 'physics: flow spikes' END, CASE WHEN zones % 4 = 1 THEN 'physics: scale jumps' END), ''), 'both tracks passed')"""
BENCH_SQL = """WITH sk AS (SELECT ['reach', 'grasp', 'lift', 'place'] AS s),
t AS (SELECT o_orderkey AS clip, o_custkey AS c, o_orderstatus AS rec, CASE WHEN o_custkey % 7 = 0 THEN [] ELSE [s[o_custkey % 4 + 1]] END AS expected, [s[o_custkey % 4 + 1], s[(o_custkey + 1) % 4 + 1], 'idle'] AS allowed, s[(o_custkey + 2) % 4 + 1] AS forbidden, s[o_custkey % 4 + 1] AS want FROM orders, sk),
seg AS (SELECT l_orderkey AS clip, CAST(l_linenumber * 10 AS DOUBLE) AS s0, l_linenumber * 10 + l_quantity AS s1, CASE WHEN l_returnflag = 'N' THEN 'idle' ELSE s[l_partkey % 4 + 1] END AS skill, l_suppkey % 2 = 0 AS ev FROM lineitem, sk),
g AS (SELECT t.clip, coalesce(list(DISTINCT skill) FILTER (skill IS NOT NULL), []) AS skills, coalesce(list(DISTINCT skill) FILTER (skill <> 'idle'), []) AS acts, count(*) FILTER (skill <> 'idle') AS na, count(*) FILTER (skill <> 'idle' AND ev) AS ne,
  min(s0) FILTER (skill = want) AS m0, max(s1) FILTER (skill = want) AS m1 FROM t LEFT JOIN seg USING (clip) GROUP BY 1),
b AS (SELECT t.clip, CASE WHEN c % 5 = 0 THEN rec = 'R' ELSE rec IN ('F', 'O') END AS verdict_ok, (c % 2 = 0) = (t.clip % 3 = 0) AS human_ok,
  CASE WHEN len(expected) = 0 THEN len(acts) = 0 ELSE list_has_any(expected, skills) END AS skill_recall,
  round(CASE WHEN len(acts) = 0 THEN CASE WHEN len(expected) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(acts, allowed)) / len(acts) END, 3) AS skill_precision,
  CASE WHEN list_contains(skills, forbidden) THEN forbidden ELSE '' END AS hallucinations,
  CAST(CASE WHEN c % 7 = 0 THEN NULL WHEN m0 IS NULL THEN 0 ELSE round(greatest(0, least(45, m1) - greatest(15, m0)) / (greatest(45, m1) - least(15, m0)), 3) END AS DOUBLE) AS boundary_iou,
  CAST(CASE WHEN c % 7 = 0 THEN NULL ELSE round((abs(m0 - 15) + abs(m1 - 45)) / 2, 2) END AS DOUBLE) AS boundary_mae_s,
  round(CASE WHEN na > 0 THEN ne / na END, 2) AS evidence_coverage FROM t JOIN g USING (clip))
"""
PCT = lambda a, b: f"CAST(CASE WHEN {b} > 0 THEN floor({a} / {b} * 100 + 0.5) END AS BIGINT)"
KPIS = f"""count(*) AS total, count(*) FILTER (good) AS succeeded, count(*) FILTER (ds) AS datasets, {PCT('count(*) FILTER (good)', 'count(*)')} AS success_rate, round(avg(seconds), 4) AS avg_seconds, CAST(coalesce(sum(zones), 0) AS BIGINT) AS zones,
 {PCT("count(*) FILTER (review_status = 'passed')", "count(*) FILTER (review_status IN ('passed', 'failed'))")} AS validation_rate, count(*) FILTER (review_status = 'failed') AS validation_failed"""


def oracle_sql() -> dict[str, str]:
    stage = f"({adapters.LINE_STAGES})[l_linenumber]"
    return {
        "kpi_block": RUNS_SQL + f"SELECT {KPIS} FROM ok",
        "kpi_rollup": RUNS_SQL + "SELECT camera, status, count(*) AS total, CAST(sum(zones) AS BIGINT) AS zones, round(avg(seconds), 4) AS avg_seconds FROM runs GROUP BY ROLLUP (camera, status)",
        "daily_timeline": RUNS_SQL + "SELECT coalesce(day, 'unknown') AS day, count(*) AS videos, count(*) FILTER (ds) AS datasets FROM ok GROUP BY 1",
        "latency_by_stage": RUNS_SQL + "SELECT camera, floor(avg(seconds) * 10 + 0.5) / 10 AS seconds FROM ok GROUP BY 1 HAVING avg(seconds) IS NOT NULL",
        "outcome_split": RUNS_SQL + "SELECT CASE WHEN good THEN 'succeeded' ELSE 'failed' END AS name, count(*) AS value FROM ok GROUP BY 1",
        "recent_runs": RUNS_SQL + "SELECT id, day, status, zones FROM ok ORDER BY day DESC, id DESC LIMIT 8",
        "acceptance_funnel": RUNS_SQL + """SELECT count(*) AS generated, count(review_status) AS reviewed, count(*) FILTER (review_status = 'passed') AS validated, count(*) FILTER (label_status = 'completed') AS labelled, count(*) FILTER (label_status = 'completed' AND status = 'completed') AS committed,
            count(*) FILTER (review_status = 'failed') AS failed_validation, count(*) FILTER (status = 'failed' AND coalesce(review_status, '') <> 'failed') AS failed_generation, count(*) FILTER (label_status = 'failed') AS failed_labelling FROM ok""",
        "throughput_rate": RUNS_SQL + "SELECT camera, round(CASE WHEN coalesce(sum(seconds), 0) > 0 THEN count(*) / sum(seconds) * 60 ELSE 0 END, 6) AS per_minute FROM ok GROUP BY 1",
        "stage_funnel": f"""WITH m AS (SELECT l_orderkey AS episode_id, {stage} AS stage, min(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'success' END) AS status FROM lineitem GROUP BY ALL),
            f AS (SELECT unnest({[*adapters.LINE_STAGES, 'report']}) AS stage, unnest(range(8)) AS place)
            SELECT f.stage, CAST(place AS INTEGER) AS place, count(*) FILTER (status IN ('success', 'skipped')) AS passed, count(*) FILTER (status = 'failed') AS failed, (SELECT count(DISTINCT episode_id) FROM m) - count(m.episode_id) AS pending FROM f LEFT JOIN m USING (stage) GROUP BY ALL""",
        "verdict_histogram": RUNS_SQL + f"SELECT v.verdict, count(o.v) AS n FROM (SELECT unnest(['accept', 'review', 'reject', 'error']) AS verdict) v LEFT JOIN (SELECT {VERDICT} AS v FROM runs) o ON o.v = v.verdict GROUP BY 1",
        "merge_verdict": RUNS_SQL + f"SELECT id, {VERDICT} AS verdict, {REASONS} AS reasons FROM runs",
        "batch_status": RUNS_SQL + """, b AS (SELECT batch, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1)
            SELECT *, CAST(least(100, floor((completed + failed) / total * 100 + 0.5)) AS BIGINT) AS progress, CASE WHEN completed + failed < total THEN 'running' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS state FROM b""",
        "batch_decision": RUNS_SQL + "SELECT batch, count(*) FILTER (NOT good) AS rejected, count(*) FILTER (NOT good) = 0 AS accepted FROM ok GROUP BY 1",
        "mode_per_group": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
        "class_presence": """WITH s AS (SELECT event_type, CAST(floor((epoch_us(ts) / 1e6 - 1704067200.0) / 3600) AS BIGINT) AS h, count(DISTINCT (user_id, ts)) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) AS p FROM s)
            SELECT event_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_seconds, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) FILTER (p <= 20) AS seconds FROM r GROUP BY 1""",
        "weighted_corr": """WITH s AS (SELECT l_returnflag, sum(l_discount) AS w, sum(l_discount * l_quantity) AS wa, sum(l_discount * l_extendedprice) AS wb, sum(l_discount * l_quantity * l_quantity) AS waa, sum(l_discount * l_extendedprice * l_extendedprice) AS wbb, sum(l_discount * l_quantity * l_extendedprice) AS wab FROM lineitem GROUP BY 1)
            SELECT l_returnflag, round((wab / w - wa / w * wb / w) / sqrt((waa / w - pow(wa / w, 2)) * (wbb / w - pow(wb / w, 2))), 6) AS corr FROM s""",
        "p95_residuals": "WITH e AS (SELECT l_linenumber, abs(l_extendedprice / l_quantity - 2000) AS e FROM lineitem) SELECT l_linenumber, count(*) AS n, round(avg(e), 1) AS mean, round(quantile_cont(e, 0.95), 1) AS p95, round(max(e), 1) AS max FROM e GROUP BY 1",
        "spend_rollup": RUNS_SQL + "SELECT camera, count(*) AS clips, CAST(sum(zones) AS BIGINT) AS attempts, round(sum(seconds), 4) AS seconds, count(*) FILTER (zones > 4) AS over_budget FROM runs GROUP BY 1",
        "sessions_by_event": RUNS_SQL + "SELECT batch, count(DISTINCT camera) AS cameras, count(*) AS n FROM ok WHERE good GROUP BY 1 HAVING count(DISTINCT camera) >= 4",
        "bench_clip": BENCH_SQL + "SELECT * FROM b",
        "bench_aggregate": BENCH_SQL + """SELECT count(*) AS n_clips, round(avg(CAST(verdict_ok AS INTEGER)), 3) AS verdict_accuracy, round(avg(CAST(human_ok AS INTEGER)), 3) AS human_accuracy, round(avg(CAST(skill_recall AS INTEGER)), 3) AS skill_recall, round(avg(skill_precision), 3) AS skill_precision_mean,
            count(*) FILTER (hallucinations <> '') AS clips_with_hallucinations, round(avg(boundary_iou), 3) AS boundary_iou_mean, round(avg(boundary_mae_s), 2) AS boundary_mae_s_mean, round(avg(evidence_coverage), 2) AS evidence_coverage_mean FROM b""",
    }
