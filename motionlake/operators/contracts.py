"""Scenarios under a world contract: validation, repair, packets for the verifier, and what a clip shows of them.

A contract and a scenario are structs (CONTRACT, SCENARIO); a world's scenarios meet its contract by a join on the
world's key. Rules are expressions over the nested arrays, so a scenario is judged within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities of a risk, the words that tell of a robot's response, synonyms of a person.
RISK_SEVERITIES = ["low", "medium", "high"]
RESPONSE_WORDS = [
    "react", "respond", "stop", "halt", "slow", "yield", "avoid", "reroute", "back", "retreat", "stabilize", "secure", "assist", "wait", "brake", "pause", "move_away", "sidestep",
]
PERSON_WORDS = ["human", "man", "woman"]

ENTITY = "struct<id:string,type:string>"
RANGE = "struct<entity_id:string,dx:array<double>,dy:array<double>>"
CONTRACT = f"""world_id string, entities array<{ENTITY}>, registry array<string>, scene_id string, identity_checks array<string>,
camera_angles array<string>, event_types array<string>, timing array<double>, deltas array<{RANGE}>, forbidden array<string>"""
STEP = "struct<actor:string,action:string,t_start:double,t_end:double>"
DELTA = "struct<entity_id:string,dx:double,dy:double>"
SCENARIO = f"""scenario_id string, title string, referenced array<string>, angle string, duration double, event_type string, description string, severity string,
trigger double, position_deltas array<{DELTA}>, timeline array<{STEP}>, response string, labels array<string>"""


def ids(entities: str) -> Column:
    return F.transform(entities, lambda e: e["id"])


def robots(entities: str) -> Column:
    """Ids of the entities whose id or type speaks of a robot."""
    return F.transform(F.filter(entities, lambda e: F.contains(F.lower(e["id"]), F.lit("robot")) | F.contains(F.lower(F.coalesce(e["type"], F.lit(""))), F.lit("robot"))), lambda e: e["id"])


def told(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ", ")


def plain(text: Column) -> Column:
    return F.translate(F.lower(text), "_-", "  ")


def limits() -> Column:
    """Bounds of a contract's deltas as entity_id and struct(lo, hi) of dx and dy: the two bounds in whichever order; without two only zero is inside."""

    def pair(bounds: Column) -> Column:
        low_high = F.array_sort(bounds)
        two = F.coalesce(F.size(bounds), F.lit(0)) == 2
        return F.struct(F.when(two, F.get(low_high, F.lit(0))).otherwise(F.lit(-1e-9)).alias("lo"), F.when(two, F.get(low_high, F.lit(1))).otherwise(F.lit(1e-9)).alias("hi"))

    return F.transform("deltas", lambda r: F.struct(r["entity_id"].alias("entity_id"), pair(r["dx"]).alias("dx"), pair(r["dy"]).alias("dy")))


def contract_errors() -> Column:
    """Errors of a contract's row."""
    locked = ids("entities")
    odd = F.array_union(F.array_except(locked, F.coalesce("registry", F.array().cast("array<string>"))), F.array_except(F.coalesce("registry", F.array().cast("array<string>")), locked))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return F.array_compact(F.array(
        F.when(F.size(odd) > 0, F.concat(F.lit("object_registry must hold exactly the locked entities: "), told(odd))),
        F.when(F.coalesce(F.length("scene_id"), F.lit(0)) == 0, F.lit("scene_registry.scene_id is required")),
        F.when(empty("identity_checks"), F.lit("identity_checks must not be empty")),
        F.when(F.size(robots("entities")) == 0, F.lit("locked_entities must include a robot")),
    ))


def without_nulls(texts: Column) -> Column:
    """The distinct texts in their order: array_except is compiled with what it reads, array_compact makes Spark interpret all of it."""
    return F.array_except(texts, F.array(F.lit(None).cast("string")))


def delta_errors(locked: Column, bounds: Column) -> Column:
    """Of position deltas: of entities that aren't locked, or may not move, or move too far; null where a rule is kept."""

    def met(d: Column) -> Column:
        bound = F.get(F.filter(bounds, lambda r: r["entity_id"] == d["entity_id"]), F.lit(0))
        return F.struct(F.coalesce(d["dx"], F.lit(0.0)).alias("dx"), F.coalesce(d["dy"], F.lit(0.0)).alias("dy"), F.coalesce(F.array_contains(locked, d["entity_id"]), F.lit(False)).alias("known"), bound.alias("bound"))

    def judge(d: Column, i: Column) -> Column:
        at = F.concat(F.lit("position_deltas["), i.cast("string"), F.lit("]: "))
        bound, moved = d["bound"], (F.abs(d["dx"]) > 1e-9) | (F.abs(d["dy"]) > 1e-9)
        far = lambda name: F.when(bound.isNotNull() & ~d[name].between(bound[name]["lo"], bound[name]["hi"]), F.concat(at, F.lit(f"{name} is out of bounds")))
        known = F.array(F.when(bound.isNull() & moved, F.concat(at, F.lit("may not move"))), far("dx"), far("dy"))
        return F.when(d["known"], known).otherwise(F.array(F.concat(at, F.lit("not a locked entity"))))

    return F.flatten(F.transform(F.transform(F.coalesce("position_deltas", F.array().cast(f"array<{DELTA}>")), met), judge))


def timeline_errors(locked: Column) -> Column:
    """Of steps: invalid spans, ends beyond the clip, an order that falls behind an earlier start, unknown actors; null where a rule is kept."""
    steps = F.col("timeline")
    starts = F.transform(steps, lambda s: F.coalesce(s["t_start"], F.lit(-1.0)))

    def judge(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("action_timeline["), i.cast("string"), F.lit("]: "))
        t0, t1 = F.coalesce(s["t_start"], F.lit(-1.0)), F.coalesce(s["t_end"], F.lit(-1.0))
        # The first step has none before it; of two, the one before it is the earlier one.
        earlier = F.when(i == 0, F.lit(-1.0)).when(i == 1, F.coalesce(F.get(steps, F.lit(0))["t_start"], F.lit(-1.0))).otherwise(F.array_max(F.slice(starts, 1, i)))
        return F.array(
            F.when((t0 < 0) | (t1 <= t0), F.concat(at, F.lit("t_start/t_end invalid"))),
            F.when(t1 > F.coalesce("duration", F.lit(0.0)) + 1e-6, F.concat(at, F.lit("ends beyond the clip"))),
            F.when(t0 < earlier, F.concat(at, F.lit("not ordered by t_start"))),
            F.when(~F.coalesce(F.array_contains(locked, s["actor"]), F.lit(False)), F.concat(at, F.lit("actor is not a locked entity"))),
        )

    return F.when(F.coalesce(F.size(steps), F.lit(0)) == 0, F.array(F.lit("action_timeline is empty"))).otherwise(F.flatten(F.transform(steps, judge)))


def responds(robot_ids: Column) -> Column:
    """Whether a robot does something like the expected response from the trigger on."""
    terms = F.filter(F.split(plain(F.coalesce("response", F.lit(""))), r"\s+"), lambda w: F.length(w) >= 3)
    acts = lambda s: F.array_contains(robot_ids, s["actor"]) & (F.coalesce(s["t_start"], F.lit(-1.0)) + 1e-6 >= F.coalesce("trigger", F.lit(-1.0)))
    actions = F.transform(F.filter(F.coalesce("timeline", F.array().cast(f"array<{STEP}>")), acts), lambda s: plain(F.coalesce(s["action"], F.lit(""))))
    return F.exists(actions, lambda a: a.rlike("|".join(RESPONSE_WORDS)) | F.exists(terms, lambda w: F.contains(a, w)))


def scenario_errors(locked: Column, robot_ids: Column, bounds: Column) -> Column:
    """Errors of a scenario that stands in one row with its contract and the ids of its entities and robots and its limits, in the order of the rules."""
    referenced = F.coalesce("referenced", F.array().cast("array<string>"))
    missing, unknown = F.array_except(locked, referenced), F.array_except(referenced, locked)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    duration, trigger = F.coalesce("duration", F.lit(0.0)), F.coalesce("trigger", F.lit(-1.0))
    window = F.size("timing") == 2
    first = F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("referenced_entities is missing "), told(missing))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("referenced_entities has unknown ids "), told(unknown))),
        F.when(no(F.array_contains("camera_angles", F.col("angle"))), F.lit("camera.angle is not allowed")),
        F.when(duration <= 0, F.lit("camera.duration_seconds must be positive")),
        F.when(no(F.array_contains("event_types", F.col("event_type"))), F.lit("event.type is not allowed")),
        F.when(no(F.col("severity").isin(RISK_SEVERITIES)), F.lit("event.risk_severity is unknown")),
        F.when(~trigger.between(F.lit(0.0), duration), F.lit("event.trigger_time_seconds is outside the clip")),
        F.when(F.coalesce(window & ~trigger.between(F.get("timing", F.lit(0)), F.get("timing", F.lit(1))), F.lit(False)), F.lit("event.trigger_time_seconds is outside the allowed window")),
    )
    last = F.array(
        F.when(F.trim(F.coalesce("response", F.lit(""))) == "", F.lit("expected_robot_response is required")),
        F.when(F.size(robot_ids) == 0, F.lit("no robot entity is available to react")),
        F.when(~responds(robot_ids), F.lit("action_timeline must include a robot response after the trigger")),
        F.when(F.coalesce(F.size("labels"), F.lit(0)) == 0, F.lit("expected_labels is empty")),
        F.when(F.trim(F.coalesce("scenario_id", F.lit(""))) == "", F.lit("scenario_id is empty")),
    )
    return without_nulls(F.concat(first, delta_errors(locked, bounds), timeline_errors(locked), last))


def judged(scenarios: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """scenarios with their contract's columns and errors, apart from equal ids; what a contract's rules need is made once a contract."""
    ready = contracts.withColumns({"__locked": ids("entities"), "__robots": robots("entities"), "__limits": limits()})
    return scenarios.join(ready, key).withColumn("errors", scenario_errors(F.col("__locked"), F.col("__robots"), F.col("__limits"))).drop("__locked", "__robots", "__limits")


def repeats(key: str, order: str) -> Column:
    """Whether an earlier scenario of the world has the same id."""
    return F.row_number().over(Window.partitionBy(key, "scenario_id").orderBy(order)) > 1


def validate(scenarios: DataFrame, contracts: DataFrame, key: str, order: str) -> DataFrame:
    """scenarios with their contract's columns and errors; of equal ids in a world only the first is free of that error."""
    rows = judged(scenarios, contracts, key)
    return rows.withColumn("errors", F.when(repeats(key, order), F.concat("errors", F.array(F.lit("scenario_id is a duplicate")))).otherwise(F.col("errors")))


def repaired(scenarios: DataFrame, contracts: DataFrame, rounds: list[DataFrame], key: str, order: str) -> DataFrame:
    """Scenarios after at most as many rounds as there are tables of fixes (key, order and a scenario's columns).

    In a round the n-th fix replaces the n-th scenario that still has errors, whatever the fix calls itself.
    """
    names = [c for c in scenarios.columns if c not in (key, order)]
    place = lambda rows: rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    for fixes in rounds:
        told = judged(scenarios, contracts, key).select(key, order, "scenario_id", (F.size("errors") > 0).alias("__bad"))
        bad = place(told.withColumn("__again", repeats(key, order)).where(F.col("__bad") | F.col("__again")).select(key, order))
        new = place(fixes).select(key, "__n", F.struct(*names).alias("__fix"))
        slots = bad.join(new, [key, "__n"]).select(key, order, "__fix")
        scenarios = scenarios.join(slots, [key, order], "left").select(key, order, *[F.when(F.col("__fix").isNotNull(), F.col(f"__fix.{c}")).otherwise(F.col(c)).alias(c) for c in names])
    return scenarios


def keyframes() -> Column:
    """Three anchors of a scenario: what begins, the trigger, and what ends."""
    says = lambda s: F.concat(s["actor"], F.lit(": "), s["action"])
    first, last = F.get("timeline", F.lit(0)), F.element_at("timeline", -1)
    begins = F.array_join(F.transform(F.filter("timeline", lambda s: s["t_start"] <= first["t_start"]), says), "; ")
    anchor = lambda t, state: F.struct(t.alias("time"), state.alias("state"))
    return F.array(anchor(F.lit(0.0), begins), anchor(F.col("trigger"), F.col("description")), anchor(F.col("duration"), says(last)))


def verifier_packet() -> Column:
    """What the verification gate is told of a scenario, from the row of a scenario and its contract."""
    return F.struct(
        F.col("title").alias("scenario_prompt"), F.transform("entities", lambda e: F.replace(e["type"], F.lit("_"), F.lit(" "))).alias("expected_objects"), F.col("event_type").alias("expected_action"),
        F.col("response").alias("expected_outcome"), "scenario_id", "world_id", F.col("registry").alias("object_registry"), "identity_checks",
        F.struct(ids("entities").alias("locked_entity_ids"), F.coalesce("scene_id", "world_id").alias("locked_scene_id"), F.coalesce("forbidden", F.array().cast("array<string>")).alias("forbidden_changes")).alias("consistency_policy"),
    )


def scenario_check(expected: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """key, detected, expected and missing: which expected objects no detected class contains or is contained in.

    expected: key, name. detected: key, label, is_person; a person is the class person, listed first.
    """
    seen = detected.groupBy(key).agg(F.array_sort(F.collect_set(F.when(~F.col("is_person"), F.col("label")))).alias("objects"), F.bool_or("is_person").alias("person"))
    seen = seen.select(key, F.concat(F.when(F.col("person"), F.array(F.lit("person"))).otherwise(F.array().cast("array<string>")), "objects").alias("detected"))
    wanted = expected.groupBy(key).agg(F.array_sort(F.collect_list(F.lower("name"))).alias("expected"))
    rows = seen.join(wanted, key, "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    hit = lambda x: F.exists("detected", lambda d: F.contains(d, x) | F.contains(x, d))
    person = lambda x: x.isin(PERSON_WORDS) & F.array_contains("detected", F.lit("person"))
    return rows.withColumn("missing", F.filter("expected", lambda x: ~(hit(x) | person(x))))


def accepted() -> Column:
    """Runs that neither failed nor were rejected in review; the others are quarantined."""
    return (F.col("status") != "failed") & ~F.coalesce(F.col("review_status").isin("failed", "rejected"), F.lit(False))


def not_accepted(rows: DataFrame, verdict: str, reasons: str, default: str = "no reason given") -> DataFrame:
    """Rows that have a verdict other than accept, with their reasons as text."""
    text = F.coalesce(F.nullif(F.array_join(reasons, "; "), F.lit("")), F.lit(default))
    return rows.where(F.col(verdict).isNotNull() & (F.col(verdict) != "accept")).withColumn("why", text)


def clamped(value: Column, low: int, high: int) -> Column:
    """A number's text as a whole number within bounds, half up; what is no number is the lower bound."""
    number = value.try_cast("double")
    return F.least(F.greatest(F.coalesce(F.floor(F.nanvl(number, F.lit(None)) + 0.5).cast("int"), F.lit(low)), F.lit(low)), F.lit(high))


def first_error(jobs: DataFrame, key: str, order: str, batch: Column, default: str = "Generation or labeling failed.") -> DataFrame:
    """The first error of a batch's jobs (its own, its label's or its render's), else the batch's, else a default."""
    own = F.coalesce("error", "label_error", "render_error")
    one = jobs.withColumns({"__own": own, "__batch": batch}).groupBy(key).agg(F.min_by("__own", F.when(F.col("__own").isNotNull(), F.col(order))).alias("__own"), F.max("__batch").alias("__batch"))
    return one.select(key, F.coalesce("__own", "__batch", F.lit(default)).alias("error"))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.startswith("/")
