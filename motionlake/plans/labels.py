"""Queries of proposed labels, annotations and directors' responses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import labels as L
from ..schemas import VERBS


def _lines(spark, sf_dir):
    """Lines of orders as segments, their order in the proposal by line."""
    return adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min(F.col("l_quantity").cast("int")).alias("q"))


def _proposals(spark, sf_dir):
    """Orders as proposals with the evidence of the tools."""
    start = "CAST(n * 2 + p % 5 - 2 AS DOUBLE)"
    step = f"named_struct('start_s', {start}, 'end_s', {start} + q % 6, 'skill', element_at(array('reach', 'walk', 'fly', 'idle'), CAST(p % 4 AS INT) + 1), 'text', if(p % 7 = 0, NULL, concat('step ', p)), 'evidence', if(p % 2 = 0, 'seen', NULL))"
    lines = _lines(spark, sf_dir).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.expr(step).alias("s")))), lambda x: x["s"]).alias("segments"))
    orders = adapters.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS c", "CAST(10 + o_custkey % 8 AS DOUBLE) AS duration", "if(o_custkey % 11 = 0, ' ', 'a clip') AS short", "if(o_custkey % 13 = 0, NULL, 'a clip of something') AS medium", "if(o_custkey % 11 = 1, NULL, 'all that happens') AS long",
        "element_at(array('none', '', 'full_body', 'partial', NULL), CAST(o_custkey % 5 AS INT) + 1) AS human_present", "element_at(array('proceed', 'reject', 'human_review', 'maybe', NULL), CAST(o_custkey % 5 AS INT) + 1) AS recommendation",
        "if(o_custkey % 6 = 0, NULL, o_totalprice / 193000) AS confidence", "CAST(if(o_custkey % 9 = 0, NULL, o_custkey % 8) AS INT) AS clutter", "(o_custkey % 10) / 10D AS person", "(o_custkey % 8) / 8D AS hands", "(o_custkey % 6) / 8D AS animal", "o_custkey % 2 = 0 AS locomoting",
        "if(o_custkey % 3 = 0, '', concat('summary ', o_custkey)) AS summary", "element_at(array(array('pose'), array('motion'), array('primitives'), CAST(array() AS array<string>), array('track', 'motion')), CAST(o_custkey % 5 AS INT) + 1) AS tools",
        "CAST(if(o_custkey % 4 = 0, array(), array('cup', 'box')) AS array<string>) AS classes",
    )
    return orders.join(lines, "id", "left")


def proposal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validated(_proposals(spark, sf_dir)).select("id", F.array_join("errors", "; ").alias("errors"), F.round("confidence", 6).alias("confidence"), "clutter")


def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_segments(_proposals(spark, sf_dir), "id", VERBS)


def heuristic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.heuristic_labels(_proposals(spark, sf_dir), "id", VERBS)


def repaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.repaired_labels(_proposals(spark, sf_dir), "id")
    return found.withColumns({"segments": F.array_join(F.transform("segments", lambda s: s["skill"]), ","), "confidence": F.round("confidence", 6)})


def temporal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposals(spark, sf_dir).select("id", L.temporal_gate((F.col("c") % 3).cast("int")).alias("asks"))


def normalized_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('label', if(p % 6 = 0, ' ', concat(' step ', n, ' ')), 't_start', CAST(n * 2 - 3 AS DOUBLE), 't_end', n * 2 - 3 + (q % 5) / 4D)"
    act = "named_struct('actors', if(p % 5 = 0, CAST(array() AS array<string>), array('worker')), 'type', if(p % 4 = 0, '', 'touch'), 't_start', if(p % 3 = 0, NULL, CAST(n AS DOUBLE)), 't_end', if(p % 3 = 0, NULL, CAST(q % 9 AS DOUBLE)))"
    rows = _lines(spark, sf_dir).groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.expr(item).alias("s")))), lambda x: x["s"]).alias("phases"), F.transform(F.array_sort(F.collect_list(F.struct("n", F.expr(act).alias("s")))), lambda x: x["s"]).alias("interactions"),
        F.max("p").alias("p"),
    )
    rows = rows.selectExpr("id", "10D AS duration", "phases", "interactions", "array(' slip ', 'fall', '', if(p % 2 = 0, 'slip', 'burn')) AS risk_states", "element_at(array('success', 'near_miss', 'odd'), CAST(p % 3 AS INT) + 1) AS outcome", "array(named_struct('question', 'who?', 'answer', if(p % 2 = 0, ' ', 'a worker')), named_struct('question', 'what?', 'answer', 'a box')) AS qa")
    found = L.normalized_annotation(rows, "id")
    told = lambda t: F.coalesce(F.round(t, 2).cast("string"), F.lit("-"))
    return found.select(
        "id", F.array_join(F.transform("phases", lambda p: F.concat_ws(":", p["label"], told(p["t_start"]), told(p["t_end"]))), ",").alias("phases"), F.array_join(F.transform("interactions", lambda a: F.concat_ws(":", a["type"], told(a["t_start"]), told(a["t_end"]))), ",").alias("interactions"),
        F.array_join("risk_states", ",").alias("risk_states"), "outcome", F.size("qa").alias("n_qa"),
    )


def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _proposals(spark, sf_dir)
    found = L.shown_labels(L.clean_segments(rows, "id", VERBS), rows.where("c % 2 = 0").select("id", "short", "medium"), "id")
    return found.withColumn("labels", F.array_join("labels", ","))


def director_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as directors' responses: a turn is an event."""
    talk = adapters.table(spark, sf_dir, "conversations")
    event = F.struct(F.col("role").alias("subject"), F.lit(None).cast("string").alias("motion_style"), F.when(F.col("turn") % 2 == 0, "dusk").alias("time_of_day"), F.lit(None).cast("string").alias("lighting"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.concat(F.lit("turn "), "turn")).alias("base_prompt"))
    rows = talk.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]).alias("events"))
    spare = spark.range(4).select(F.col("id").cast("int").alias("place"), F.lit("person").alias("subject"), F.lit("slow").alias("motion_style"), F.lit("night").alias("time_of_day"), F.lit("lamp").alias("lighting"), F.concat(F.lit("spare "), "id").alias("base_prompt"))
    return L.director_events(rows, "conv_id", 4, spare)


NAMES = [proposal_errors, clean_segments, heuristic_labels, repaired_labels, temporal_gate, normalized_annotations, shown_labels, director_events]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


LINES = """WITH li AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_partkey) AS p, min(CAST(trunc(l_quantity) AS INTEGER)) AS q FROM lineitem GROUP BY ALL)"""
PROPOSALS = (
    LINES
    + """,
se AS (SELECT id, n, p, CAST(n * 2 + p % 5 - 2 AS DOUBLE) AS s, CAST(n * 2 + p % 5 - 2 AS DOUBLE) + q % 6 AS e, (['reach', 'walk', 'fly', 'idle'])[p % 4 + 1] AS skill, CASE WHEN p % 7 <> 0 THEN 'step ' || p END AS text, CASE WHEN p % 2 = 0 THEN 'seen' END AS ev FROM li),
sk AS (SELECT id, list(skill ORDER BY n) AS skills, string_agg(coalesce(text, skill), '; ' ORDER BY n) FILTER (k <= 4) AS said FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM se) GROUP BY 1),
pr AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(10 + o_custkey % 8 AS DOUBLE) AS duration, CASE WHEN o_custkey % 11 = 0 THEN ' ' ELSE 'a clip' END AS short, CASE WHEN o_custkey % 13 <> 0 THEN 'a clip of something' END AS medium, CASE WHEN o_custkey % 11 <> 1 THEN 'all that happens' END AS long,
  (['none', '', 'full_body', 'partial', NULL])[o_custkey % 5 + 1] AS hp, (['proceed', 'reject', 'human_review', 'maybe', NULL])[o_custkey % 5 + 1] AS rec, CASE WHEN o_custkey % 6 <> 0 THEN o_totalprice / 193000 END AS conf, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 8 END AS clutter,
  (o_custkey % 10) / 10.0 AS person, (o_custkey % 8) / 8.0 AS hands, (o_custkey % 6) / 8.0 AS animal, o_custkey % 2 = 0 AS loco, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'summary ' || o_custkey END AS summary, (['pose', 'motion', 'primitives', '', 'motion'])[o_custkey % 5 + 1] AS tool, skills, said
  FROM orders LEFT JOIN sk ON sk.id = o_orderkey),
acts AS (SELECT *, list_sort(list_distinct([s FOR s IN skills IF s IN ('reach', 'fly')])) AS acts, CASE WHEN person > 0.5 THEN 'full_body' WHEN hands > 0.3 THEN 'hands_only' ELSE 'none' END AS presence FROM pr)"""
)
CLEAN = (
    PROPOSALS
    + """,
ho AS (SELECT se.*, duration, least(greatest(s, 0), duration) AS s0, least(greatest(e, 0), duration) AS s1 FROM se JOIN pr USING (id)),
cu AS (SELECT *, greatest(s0, coalesce(max(s1) OVER (PARTITION BY id ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s0)) AS cut FROM ho WHERE s1 - s0 >= 0.001),
gd AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s, n) - 1 AS INTEGER) AS place, cut AS start_s, s1 AS end_s, CASE skill WHEN 'fly' THEN 'idle' ELSE skill END AS skill, coalesce(text, '') AS text, ev AS evidence FROM cu WHERE cut < s1),
cl AS (SELECT * FROM gd UNION ALL SELECT id, 0, 0, duration, 'idle', 'no confident segmentation', NULL FROM pr WHERE id NOT IN (SELECT id FROM gd))"""
)


def oracle_sql() -> dict[str, str]:
    lacks = lambda what, parts: f"CASE WHEN {' OR '.join(b for _, b in parts)} THEN '{what} incomplete: ' || concat_ws(', ', {', '.join(f'CASE WHEN {b} THEN {chr(39)}{n}{chr(39)} END' for n, b in parts)}) END"
    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    return {
        "proposal_errors": PROPOSALS
        + f""" SELECT id, concat_ws('; ', {lacks('captions', [(c, blank(c)) for c in ('short', 'medium', 'long')])}, {lacks('feasibility', [('human_present', blank('hp')), ('recommendation', blank('rec'))])}, CASE WHEN rec = 'maybe' THEN 'invalid recommendation' END,
            CASE WHEN hp = 'none' AND len(acts) > 0 THEN 'contradiction: no human, but ' || array_to_string(acts, ', ') END) AS errors, round(least(greatest(coalesce(conf, 0.3), 0), 1), 6) AS confidence, CAST(least(greatest(coalesce(clutter, 3), 1), 5) AS INTEGER) AS clutter FROM acts""",
        "clean_segments": CLEAN + " SELECT * FROM cl",
        "heuristic_labels": PROPOSALS + """ SELECT id, presence AS human_present, 0.0 AS start_s, duration AS end_s, CASE presence WHEN 'hands_only' THEN 'hold' ELSE 'idle' END AS skill, 'heuristic: human=' || presence || ', objects=' || CASE WHEN c % 4 = 0 THEN 'none detected' ELSE 'cup, box' END AS text,
            person > 0.5 AS tracking_valid, 0.3 AS confidence, 'human_review' AS recommendation FROM acts""",
        "repaired_labels": PROPOSALS
        + """, r AS (SELECT *, coalesce(nullif(summary, ''), nullif(said, ''), 'unlabeled activity') AS su, animal > 0.3 AS an, coalesce(nullif(hp, ''), CASE WHEN animal > 0.3 AND person <= 0.5 THEN 'none' ELSE presence END) AS hu FROM acts),
            o AS (SELECT *, hu = 'none' AND len(coalesce(acts, [])) > 0 AS odd FROM r)
            SELECT id, coalesce(short, left(su, 120)) AS short, coalesce(medium, left(su, 300)) AS medium, coalesce(long, left(su || ' Segments: ' || coalesce(said, ''), 800)) AS long, CASE WHEN odd AND NOT an THEN 'partial' ELSE hu END AS human_present, CASE WHEN odd THEN 'human_review' ELSE coalesce(rec, 'human_review') END AS recommendation,
              round(coalesce(conf, 0.4), 6) AS confidence, coalesce(array_to_string([CASE WHEN odd AND an AND s IN ('reach', 'fly') THEN CASE WHEN loco THEN 'walk' ELSE 'stand' END ELSE s END FOR s IN skills], ','), '') AS segments, skills IS NOT NULL AS usable FROM o""",
        "temporal_gate": PROPOSALS + """ SELECT id, CASE WHEN NOT coalesce(rec = 'proceed' AND len([s FOR s IN skills IF s <> 'idle']) > 0, false) OR c % 3 >= 2 THEN NULL WHEN tool NOT IN ('motion', 'primitives') THEN 'measure boundaries' WHEN tool <> 'primitives' AND c % 3 = 0 AND c % 5 IN (0, 4) THEN 'run primitives' END AS asks FROM pr""",
        "normalized_annotations": LINES
        + """, ph AS (SELECT id, n, 'step ' || n AS label, greatest(n * 2 - 3.0, 0) AS a, least(n * 2 - 3 + (q % 5) / 4.0, 10) AS b FROM li WHERE p % 6 <> 0),
            pa AS (SELECT id, string_agg(label || ':' || round(CAST(a AS DOUBLE), 2) || ':' || round(CAST(b AS DOUBLE), 2), ',' ORDER BY a, -n) AS phases FROM ph WHERE b > a GROUP BY 1),
            ia AS (SELECT id, string_agg('touch:' || CASE WHEN p % 3 = 0 OR least(q % 9, 10) <= n THEN '-:-' ELSE CAST(n AS DOUBLE) || ':' || CAST(least(q % 9, 10) AS DOUBLE) END, ',' ORDER BY n) AS ints FROM li WHERE p % 5 <> 0 AND p % 4 <> 0 GROUP BY 1),
            k AS (SELECT id, max(p) AS p FROM li GROUP BY 1)
            SELECT k.id, coalesce(phases, '') AS phases, coalesce(ints, '') AS interactions, CASE WHEN p % 2 = 0 THEN 'fall,slip' ELSE 'burn,fall,slip' END AS risk_states, (['success', 'near_miss', 'unclear'])[p % 3 + 1] AS outcome, CASE WHEN p % 2 = 0 THEN 1 ELSE 2 END AS n_qa FROM k LEFT JOIN pa USING (id) LEFT JOIN ia USING (id)""",
        "shown_labels": CLEAN + " SELECT p.id, coalesce(short, '') AS video_summary, coalesce(medium, '') AS summary, array_to_string(list_sort(list_distinct(list(skill))), ',') AS labels, count(*) AS n_segments FROM pr p JOIN cl USING (id) WHERE c % 2 = 0 GROUP BY ALL",
        "director_events": """WITH o AS (SELECT conv_id, turn AS i, role AS subject, 'natural pace' AS motion_style, CASE WHEN turn % 2 = 0 THEN 'dusk' ELSE 'midday' END AS time_of_day, 'natural light' AS lighting, 'turn ' || turn AS base_prompt FROM conversations WHERE turn < 4 AND turn % 3 <> 1),
            c AS (SELECT k.conv_id, count(o.i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN o USING (conv_id) GROUP BY 1), b AS (SELECT * FROM o UNION ALL SELECT conv_id, 4 + p, 'person', 'slow', 'night', 'lamp', 'spare ' || p FROM c, range(4) r(p) WHERE p < 4 - n)
            SELECT b.conv_id, 'e' || lpad(CAST(CASE WHEN n < 4 THEN row_number() OVER (PARTITION BY b.conv_id ORDER BY i) - 1 ELSE i END AS VARCHAR), 2, '0') AS event_id, subject, motion_style, time_of_day, lighting, base_prompt FROM b JOIN c USING (conv_id)""",
    }
