"""Queries of episodes' decisions, reports and funnel; an episode is an order, its stages its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import episodes as E

ROBOTS = ["go2", "g1"]
MOCK = [120, 100, 90, 80, 70, 60, 50]


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("quantity") % 3 != 0, F.concat(F.lit("quantity "), F.col("quantity").cast("long").cast("string")))
    return adapters.manifests(spark, sf_dir).select("episode_id", "stage", "status", metric.alias("metric"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "episode_id")


def qa_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-checks of an episode: every third fails, for one to five reasons."""
    k = F.col("episode_id")
    why = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.lit("reason "), i))
    checks = _orders(spark, sf_dir).select("episode_id", (k % 3 != 0).alias("passed"), F.when(k % 3 == 0, why).alias("reasons"))
    return E.decisions(_manifests(spark, sf_dir), checks, "episode_id")


def job_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.job_funnel(_manifests(spark, sf_dir), "episode_id", adapters.LINE_STAGES, MOCK)


def stage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = _orders(spark, sf_dir), F.col("episode_id")
    feasibility = orders.where("episode_id % 4 != 0").select(
        "episode_id", F.when(F.col("o_orderstatus") == "F", "proceed").otherwise("human_review").alias("recommendation"), (k % 100 / 100).alias("confidence"), (k % 1000 / 1000).alias("violation_ratio"), (k % 2 == 0).alias("plausible"),
        F.lit("offline").alias("judge"), F.when(k % 5 == 0, F.array(F.lit("blur"), F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>")).alias("artifacts"),
    )
    physics = orders.where("episode_id % 3 = 1").select("episode_id", F.lit(ROBOTS[1]).alias("robot"), (k % 2 == 1).alias("valid"))
    return E.stage_reports(_manifests(spark, sf_dir), feasibility, physics, "episode_id", ROBOTS)


NAMES = [qa_decisions, job_funnel, stage_reports]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


MANIFESTS = f"""WITH m AS (SELECT l_orderkey AS episode_id, ({adapters.LINE_STAGES})[l_linenumber] AS stage, min(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'success' END) AS status,
  CASE WHEN sum(l_quantity) % 3 <> 0 THEN 'quantity ' || CAST(sum(l_quantity) AS BIGINT) END AS metric FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def oracle_sql() -> dict[str, str]:
    stage = " || ".join(f"'| {s} | ' || coalesce(max(status) FILTER (stage = '{s}'), '{E.PENDING}') || ' | ' || coalesce(max(metric) FILTER (stage = '{s}'), '{E.NOTHING}') || ' |' || chr(10)" for s in E.REPORTED)
    py = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    robots = " || ".join(f"'- **{r}**: retarget={E.NOTHING}, physics_valid=' || " + (f"CASE WHEN k % 3 = 1 AND known THEN {py('k % 2 = 1')} ELSE '{E.NOTHING}' END" if r == ROBOTS[1] else f"'{E.NOTHING}'") + " || chr(10)" for r in ROBOTS)
    return {
        "qa_decisions": MANIFESTS
        + f""", g AS (SELECT episode_id, count(*) AS n, string_agg(stage, ',' ORDER BY stage) FILTER (status <> 'success') AS failed FROM m WHERE stage IN {tuple(E.GATED)} AND metric IS NOT NULL GROUP BY 1),
            d AS (SELECT o_orderkey AS episode_id, o_orderkey % 3 <> 0 AND failed IS NULL AS ok, coalesce(n, 0) AS gates, coalesce(failed, '') AS failed_gates FROM orders LEFT JOIN g ON g.episode_id = o_orderkey)
            SELECT episode_id, ok AS accepted, gates, failed_gates, CASE WHEN NOT ok THEN 'qa' END AS failure_stage, CASE WHEN NOT ok THEN CASE WHEN episode_id % 3 = 0 THEN array_to_string(['reason ' || i FOR i IN range(least({E.REASONS}, episode_id % 5 + 1))], '; ') ELSE '' END END AS failure_reason FROM d""",
        "job_funnel": MANIFESTS
        + f""", f AS (SELECT unnest({adapters.LINE_STAGES}) AS stage, unnest(range({len(adapters.LINE_STAGES)})) AS place)
            SELECT f.stage, CAST(place AS INTEGER) AS place, count(*) FILTER (status IN ('success', 'skipped')) AS count, (SELECT count(DISTINCT episode_id) FROM m) AS total, false AS mock FROM f LEFT JOIN m USING (stage) GROUP BY ALL""",
        "stage_reports": MANIFESTS
        + f""", t AS (SELECT episode_id AS k, {stage} AS stages FROM m GROUP BY 1), o AS (SELECT t.*, o_orderkey IS NOT NULL AS known, o_orderstatus, o_orderpriority FROM t LEFT JOIN orders ON o_orderkey = k)
            SELECT k AS episode_id, '# Yield Report — ' || k || chr(10) || chr(10) || '| Stage | Status | Key metric |' || chr(10) || '|-------|--------|------------|' || chr(10) || stages
              || CASE WHEN known AND k % 4 <> 0 THEN chr(10) || '## Feasibility gate (pre-analysis QA)' || chr(10) || chr(10) || '- recommendation: **' || CASE WHEN o_orderstatus = 'F' THEN 'proceed' ELSE 'human_review' END || '**' || chr(10)
                || '- confidence: ' || printf('%.2f', k % 100 / 100) || chr(10) || '- physics_violation_frame_ratio: ' || printf('%.3f', k % 1000 / 1000) || chr(10) || '- physically_plausible: ' || {py('k % 2 = 0')} || chr(10) || '- judge_source: offline' || chr(10)
                || CASE WHEN k % 5 = 0 THEN '- ai_artifacts: blur, ' || o_orderpriority || chr(10) ELSE '' END ELSE '' END || chr(10) || '## Retarget / physics by robot' || chr(10) || chr(10) || {robots} AS report FROM o""",
    }
