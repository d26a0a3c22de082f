"""Queries of names, messages, contracts, findings, labels and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import text as X
from ..operators import documents as D
from ..schemas import VERBS
from .reports import SKILLS
from .timeline import SERIES, TURNS


def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "pages")
    return pages.select("page_id", X.slug(F.col("url"), 40).alias("slug"), X.safe_filename(F.col("url")).alias("file"), X.episode_id(F.lit("page"), F.col("page_id")).alias("episode"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    name = F.concat(F.lit("sc_"), F.col("p_partkey").cast("string"), F.lit("_"), F.regexp_replace("p_name", " ", "_"))
    return part.select("p_partkey", X.titleize(name).alias("title"), F.array_join(X.terms(F.col("p_name")), ",").alias("terms"))


def _messages(spark, sf_dir):
    """Log messages out of events."""
    texts = {"error": "Error: generation failed for ", "view": "Parsing intent ", "click": "skipped: dropping one scenario of ", "signup": "error in visual ANCHORS ", "purchase": "Planning 3 scenario variations "}
    say = F
    for kind, text in texts.items():
        say = say.when(F.col("event_type") == kind, F.concat(F.lit(text), "event_id"))
    job = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("batch-"), F.col("user_id"), F.lit("-job-"), F.col("event_id"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("single run "), F.col("event_id")))
    return adapters.table(spark, sf_dir, "events").select("event_id", say.alias("message"), job.alias("job_id"), "value")


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir)
    return rows.select("event_id", X.agent_of(F.col("message")).alias("agent"), X.level_of(F.col("message")).alias("level"), X.batch_of(F.col("job_id")).alias("batch_id"), X.seconds_text(F.col("value")).alias("took"))


def keyword_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = adapters.table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in ("Pick", "lift", "look at", "PUT")]), (F.col("event_id") % 4).cast("int") + 1), F.lit("the box,"), F.element_at(F.array(*[F.lit(w) for w in ("grab it", "wait", "raise")]), (F.col("user_id") % 3).cast("int") + 1)).alias("p")
    )
    return prompts.select("event_id", F.array_join(X.skills_of(F.col("p"), VERBS), ",").alias("skills"))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.series(spark, sf_dir).select("user_id", "event_type", "t", (F.col("v") / 100).alias("conf"), F.when(F.col("k") % 7 == 0, "guess").otherwise("captured").alias("source"), F.col("k").alias("frame"))
    return D.contract_violations(rows, ["t", "conf", "source", "valid"], ["user_id", "event_type"])


def parsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a reviewer made of events: JSON within prose."""
    kind = F.element_at(F.array(*[F.lit(k) for k in [*D.FINDING_TYPES[:3], "unknown"]]), (F.col("user_id") % 4).cast("int") + 1)
    reply = F.format_string('Here: ```{"findings": [{"type": "%s", "severity": %s, "frames": [%d, -1, %d]}, {"type": "magic_effect", "severity": 2.0}]}```', kind, F.round(F.col("value") / 100, 2).cast("string"), F.col("user_id").cast("int"), (F.col("user_id") % 5).cast("int"))
    found = D.parse_findings(adapters.table(spark, sf_dir, "events").select("event_id", reply.alias("reply")), "event_id", "reply")
    return found.select("event_id", "type", F.round("severity", 6).alias("severity"), F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"), "place")


def scenario_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return D.duplicate_ids(rows.withColumn("name", F.col("p") % 10), ["l_orderkey"], "name", "l_linenumber").select("l_orderkey", "l_linenumber", "name")


def entity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 6).alias("e"), (F.col("l_suppkey") % 6).alias("f"))
    found = D.set_errors(items.select("l_orderkey", "e"), items.select("l_orderkey", F.col("f").alias("e")), ["l_orderkey"], "e")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("l_orderkey", text("missing"), text("unknown"))


def clean_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.intervals(spark, sf_dir).withColumns({"duration": F.lit(60.0), "start_s": F.col("start_s") - 3.0})
    return D.clean_spans(turns, "start_s", "end_s", "duration").select("conv_id", "turn", F.round("start_s", 1).alias("start_s"), F.round("end_s", 1).alias("end_s"))


def gate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.runs(spark, sf_dir).select("id", "seconds", F.nullif(F.col("zones"), F.lit(0)).alias("zones"))
    return D.apply_gates(runs, [("seconds", "le", 300.0, True), ("zones", "ge", 2, False)]).select("id", "passed", F.array_join("reasons", "; ").alias("reasons"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill = F.when(F.col("l_returnflag") == "N", "idle").otherwise(F.element_at(F.array(*[F.lit(s) for s in SKILLS]), (F.col("l_partkey") % 4).cast("int") + 1))
    seg = adapters.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(skill).alias("skill"))
    return D.captions(seg, ["l_orderkey"], "l_linenumber", "skill")


def turn_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: role, first words, and the first that isn't empty of text and role."""
    talk = adapters.intervals(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")))
    return talk.select("conv_id", "turn", F.substring(D.first_non_empty("text", "role"), 1, 16).alias("label"), D.any_contains(F.lower("text"), ["the ", "der ", "que "]).alias("known"))


NAMES = [url_slugs, titles, log_fields, keyword_skills, contract_violations, parsed_findings, scenario_duplicates, entity_errors, clean_spans, gate_thresholds, captions, turn_speakers]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    msg = """WITH m AS (SELECT event_id, value, CASE event_type WHEN 'error' THEN 'Error: generation failed for ' WHEN 'view' THEN 'Parsing intent ' WHEN 'click' THEN 'skipped: dropping one scenario of ' WHEN 'signup' THEN 'error in visual ANCHORS ' ELSE 'Planning 3 scenario variations ' END || event_id AS message,
      CASE event_id % 3 WHEN 0 THEN 'batch-' || user_id || '-job-' || event_id WHEN 1 THEN 'single run ' || event_id END AS job_id FROM events)"""
    agents = "CASE " + " ".join(f"WHEN regexp_matches(message, '(?i){p}') THEN '{a}'" for p, a in X.AGENTS) + f" ELSE '{X.OTHER_AGENT}' END"
    words = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SKILL_WORDS.items()) + " END"
    skill = "CASE WHEN l_returnflag = 'N' THEN 'idle' ELSE (['reach', 'grasp', 'lift', 'place'])[l_partkey % 4 + 1] END"
    return {
        "url_slugs": r"""SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') AS file, 'page_' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS episode
            FROM (SELECT *, substring(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS s FROM pages)""",
        "titles": """WITH t AS (SELECT p_partkey, trim(regexp_replace(regexp_replace('sc_' || p_partkey || '_' || replace(p_name, ' ', '_'), '^sc_?[0-9]+_?', ''), '[_-]+', ' ', 'g')) AS s, [w FOR w IN regexp_split_to_array(trim(regexp_replace(lower(p_name), '[_-]', ' ', 'g')), '[^a-z0-9]+') IF length(w) >= 3] AS ws FROM part)
            SELECT p_partkey, upper(substring(s, 1, 1)) || substring(s, 2) AS title, array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF list_position(ws, ws[i]) = i], ',') AS terms FROM t""",
        "log_fields": msg + f""" SELECT event_id, {agents} AS agent, CASE WHEN regexp_matches(lower(message), 'failed|skipped') THEN 'warn' WHEN starts_with(lower(message), 'error') THEN 'error' ELSE 'info' END AS level,
            CASE WHEN regexp_matches(job_id, '^(.*)-job-[0-9]+$') THEN regexp_extract(job_id, '^(.*)-job-[0-9]+$', 1) ELSE substring(job_id, 1, 12) END AS batch_id,
            CASE WHEN value < 90 THEN CAST(floor(value + 0.5) AS BIGINT) || 's' ELSE CAST(floor(floor(value + 0.5) / 60) AS BIGINT) || 'm ' || lpad(CAST(CAST(floor(value + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's' END AS took FROM m""",
        "keyword_skills": f"""WITH p AS (SELECT event_id, lower((['Pick', 'lift', 'look at', 'PUT'])[event_id % 4 + 1] || ' the box, ' || (['grab it', 'wait', 'raise'])[user_id % 3 + 1]) AS p FROM events),
            w AS (SELECT event_id, unnest(regexp_split_to_array(translate(p, ',.', '  '), ' +')) AS w, unnest(range(len(regexp_split_to_array(translate(p, ',.', '  '), ' +')))) AS i FROM p), x AS (SELECT event_id, i, {words} AS s FROM w), s AS (SELECT event_id, s, min(i) AS i FROM x WHERE s IS NOT NULL GROUP BY event_id, s)
            SELECT p.event_id, coalesce(string_agg(s, ',' ORDER BY i), '{VERBS[-1]}') AS skills FROM p LEFT JOIN s USING (event_id) GROUP BY 1""",
        "contract_violations": f"""WITH {SERIES.replace("AS v FROM", "AS v, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), event_id) AS k FROM")}, s AS (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY k, t) AS p FROM series),
            c AS (SELECT count(*) FILTER (v / 100 > 1) AS a, count(*) FILTER (k % 7 = 0) AS b, count(*) FILTER (t <= p) AS c FROM s)
            SELECT rule, n FROM (SELECT 'missing column valid' AS rule, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'conf outside [0, 1]', a FROM c UNION ALL SELECT 'unknown source', b FROM c UNION ALL SELECT 't doesn''t rise', c FROM c) WHERE n > 0""",
        "parsed_findings": """WITH r AS (SELECT event_id, user_id, (['anatomical_anomaly', 'magic_effect', 'object_morphing', 'unknown'])[user_id % 4 + 1] AS type, least(1, round(value / 100, 2)) AS sev, list_sort(list_distinct([CAST(user_id AS INTEGER), CAST(user_id % 5 AS INTEGER)])) AS frames FROM events),
            f AS (SELECT event_id, 0 AS pos, type, sev, frames FROM r WHERE type <> 'unknown' AND sev >= 0.75 UNION ALL SELECT event_id, 1, 'magic_effect', 1.0, [0] FROM r)
            SELECT event_id, type, round(least(sev * 0.4, 0.4), 6) AS severity, array_to_string(frames, ',') AS frames, CAST(row_number() OVER (PARTITION BY event_id ORDER BY sev DESC, pos) AS INTEGER) AS place FROM f""",
        "scenario_duplicates": "WITH i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 10 AS name FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, name FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey, name ORDER BY l_linenumber) > 1",
        "entity_errors": """WITH i AS (SELECT l_orderkey, l_partkey % 6 AS e, l_suppkey % 6 AS f FROM lineitem), m AS (SELECT l_orderkey, e, 1 AS k FROM (SELECT l_orderkey, e FROM i EXCEPT SELECT l_orderkey, f FROM i) UNION ALL SELECT l_orderkey, f, 2 FROM (SELECT l_orderkey, f FROM i EXCEPT SELECT l_orderkey, e FROM i))
            SELECT l_orderkey, coalesce(string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FILTER (k = 1), '') AS missing, coalesce(string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FILTER (k = 2), '') AS unknown FROM m GROUP BY 1""",
        "clean_spans": f"WITH {TURNS}, c AS (SELECT conv_id, turn, round(least(greatest(start_s - 3, 0), 60), 1) AS start_s, round(least(greatest(end_s, 0), 60), 1) AS end_s FROM turns) SELECT * FROM c WHERE start_s < end_s",
        "gate_thresholds": """WITH z AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'seconds is missing' WHEN o_totalprice / 1000 > 300 THEN 'seconds above 300' END AS a, CASE WHEN z.n < 2 THEN 'zones below 2' END AS b FROM orders LEFT JOIN z ON l_orderkey = o_orderkey)
            SELECT id, a IS NULL AND b IS NULL AS passed, concat_ws('; ', a, b) AS reasons FROM g""",
        "captions": f"WITH s AS (SELECT l_orderkey, l_linenumber, min({skill}) AS skill FROM lineitem GROUP BY ALL), u AS (SELECT l_orderkey, skill, min(l_linenumber) AS i, count(*) AS n FROM s WHERE skill <> 'idle' GROUP BY ALL) SELECT l_orderkey, string_agg(skill, ', then ' ORDER BY i) AS caption, string_agg(skill || ':' || n, ',' ORDER BY i) AS counts FROM u GROUP BY 1",
        "turn_speakers": "WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations) SELECT conv_id, turn, substring(CASE WHEN length(trim(text)) > 0 THEN text WHEN length(trim(role)) > 0 THEN role END, 1, 16) AS label, contains(lower(text), 'the ') OR contains(lower(text), 'der ') OR contains(lower(text), 'que ') AS known FROM t",
    }
