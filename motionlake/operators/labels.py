"""Labels that models propose: validation, fallbacks and repair from evidence, normal forms, director's responses.

Documents are rows with nested arrays. What makes a label useless is told as an error; everything else is mended in
place, so no row is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import VERBS

# What a recommendation may be, skills that need no human, outcomes, shares that tell of a person, hands, an animal.
RECOMMENDATIONS = ["proceed", "reject", "human_review"]
WITHOUT_HUMAN = ["idle", "walk", "trot", "gallop", "jump", "sit", "lie_down", "stand", "turn"]
OUTCOMES = ["success", "failure", "near_miss", "unclear"]
PERSON_SHARE, HANDS_SHARE, ANIMAL_SHARE = 0.5, 0.3, 0.3
#: Tools whose evidence measures where segments begin and end, and those that only tell of motion.
BOUNDARY_TOOLS = ["primitives", "video_analysis", "motion"]
CHANNEL_TOOLS = ["pose", "hands", "track"]

SEGMENT = "struct<start_s:double,end_s:double,skill:string,text:string,evidence:string>"
#: Columns of a proposal beside its key.
LABELS = f"duration double, short string, medium string, long string, human_present string, recommendation string, confidence double, clutter int, segments array<{SEGMENT}>"


def label_errors() -> Column:
    """Why a proposal can't be used: captions or verdict are incomplete, or they contradict the segments."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lacks = lambda what, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{what} incomplete: "), F.array_join(names, ", ")))
    captions = F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in ("short", "medium", "long")]))
    verdict = F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in ("human_present", "recommendation")]))
    acts = F.array_sort(F.array_except(F.transform("segments", lambda s: s["skill"]), F.array(*[F.lit(v) for v in WITHOUT_HUMAN])))
    return F.array_compact(F.array(
        lacks("captions", captions), lacks("feasibility", verdict),
        F.when(~empty("recommendation") & ~F.col("recommendation").isin(RECOMMENDATIONS), F.lit("invalid recommendation")),
        F.when((F.col("human_present") == "none") & (F.coalesce(F.size(acts), F.lit(0)) > 0), F.concat(F.lit("contradiction: no human, but "), F.array_join(acts, ", "))),
    ))


def clean_segments(rows: DataFrame, key: str, verbs: list[str] = VERBS) -> DataFrame:
    """key, place, start_s, end_s, skill, text and evidence of each proposal's segments (key, duration, segments).

    Spans are held within the clip and, in the order of their starts, cut where an earlier one ends, unknown skills become idle, texts are cut to
    200 and evidence to 300 characters; a proposal that has none left is one idle segment.
    """
    idle = "idle" if "idle" in verbs else verbs[0]
    hold = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("duration"))
    each = rows.select(key, "duration", F.posexplode("segments").alias("i", "s")).select(key, "duration", "i", hold(F.col("s.start_s")).alias("start_s"), hold(F.col("s.end_s")).alias("end_s"), F.coalesce("s.start_s", F.lit(0.0)).alias("said"), "s.skill", "s.text", "s.evidence")
    order = Window.partitionBy(key).orderBy("said", "i")
    cut = F.greatest(F.col("start_s"), F.coalesce(F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_s")))
    kept = each.where(F.col("end_s") - F.col("start_s") >= 1e-3).withColumn("start_s", cut).where(F.col("end_s") > F.col("start_s"))
    skill = F.when(F.col("skill").isin(verbs), F.col("skill")).otherwise(F.lit(idle))
    place = (F.row_number().over(order) - 1).cast("int")
    good = kept.select(key, place.alias("place"), "start_s", "end_s", skill.alias("skill"), F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("text"), F.left("evidence", F.lit(300)).alias("evidence"))
    none = rows.join(good.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("place"), F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s"), F.lit(idle).alias("skill"), F.lit("no confident segmentation").alias("text"), F.lit(None).cast("string").alias("evidence"))
    return good.unionByName(none)


def bounded(value: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def validated(rows: DataFrame) -> DataFrame:
    """rows with errors, and confidence and clutter held within their bounds."""
    return rows.withColumns({"errors": label_errors(), "confidence": bounded(F.col("confidence"), 0.0, 1.0, 0.3), "clutter": bounded(F.col("clutter"), 1, 5, 3).cast("int")})


def presence(person: Column, hands: Column) -> Column:
    return F.when(F.coalesce(person, F.lit(0.0)) > PERSON_SHARE, "full_body").when(F.coalesce(hands, F.lit(0.0)) > HANDS_SHARE, "hands_only").otherwise("none")


def heuristic_labels(evidence: DataFrame, key: str, verbs: list[str] = VERBS) -> DataFrame:
    """Labels from the tools' evidence alone: key, duration, person, hands (shares), classes (array) -> one segment, for review."""
    rows = evidence.withColumn("human_present", presence(F.col("person"), F.col("hands")))
    idle = "idle" if "idle" in verbs else verbs[0]
    skill = F.when((F.col("human_present") == "hands_only") & F.lit("hold" in verbs), "hold").otherwise(idle)
    some = F.array_join(F.slice(F.coalesce("classes", F.array().cast("array<string>")), 1, 5), ", ")
    seen = F.coalesce(F.nullif(some, F.lit("")), F.lit("none detected"))
    return rows.select(
        key, "human_present", F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s"), skill.alias("skill"), F.concat(F.lit("heuristic: human="), "human_present", F.lit(", objects="), seen).alias("text"),
        (F.coalesce("person", F.lit(0.0)) > PERSON_SHARE).alias("tracking_valid"), F.lit(0.3).alias("confidence"), F.lit("human_review").alias("recommendation"),
    )


def repaired_labels(rows: DataFrame, key: str) -> DataFrame:
    """Proposals whose captions and verdict are filled from the evidence beside them, their segments kept.

    rows: key, LABELS, and the evidence person, hands, animal (shares), locomoting, summary. A proposal without segments, or with
    one without a skill, can't be repaired (usable is false). An animal can't do what needs a human: such skills become
    walk or stand; where no animal is seen either, a human must be there in part. Both go to review.
    """
    steps = F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>"))
    said = F.array_join(F.transform(F.slice(steps, 1, 4), lambda s: F.coalesce(s["text"], s["skill"])), "; ")
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.nullif(said, F.lit("")), F.lit("unlabeled activity"))
    animal = F.coalesce(F.col("animal") > ANIMAL_SHARE, F.lit(False))
    human = F.coalesce(F.nullif("human_present", F.lit("")), F.when(animal & (F.coalesce("person", F.lit(0.0)) <= PERSON_SHARE), "none").otherwise(presence(F.col("person"), F.col("hands"))))
    acts = F.exists(steps, lambda s: ~s["skill"].isin(WITHOUT_HUMAN))
    odd = F.coalesce((human == "none") & acts, F.lit(False))
    moves = F.when(F.coalesce("locomoting", F.lit(False)), "walk").otherwise("stand")
    coerced = F.transform(steps, lambda s: s.withField("skill", F.when(s["skill"].isin(WITHOUT_HUMAN), s["skill"]).otherwise(moves)))
    text = lambda name, most: F.coalesce(name, F.left(summary, F.lit(most))).alias(name)
    return rows.select(
        key, text("short", 120), text("medium", 300), F.coalesce("long", F.left(F.concat(summary, F.lit(" Segments: "), said), F.lit(800))).alias("long"),
        F.when(odd & ~animal, "partial").otherwise(human).alias("human_present"), F.when(odd, "human_review").otherwise(F.coalesce("recommendation", F.lit("human_review"))).alias("recommendation"),
        F.coalesce("confidence", F.lit(0.4)).alias("confidence"), F.when(odd & animal, coerced).otherwise(steps).alias("segments"), ((F.size(steps) > 0) & ~F.exists(steps, lambda s: s["skill"].isNull())).alias("usable"),
    )


def temporal_gate(fires: Column) -> Column:
    """What is asked for before a proposal is final: measured boundaries, or primitives where motion was seen; else null.

    Columns: recommendation, segments and tools (array of those that have run); fires: how often the gate has asked.
    """
    acts = F.exists(F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>")), lambda s: s["skill"] != "idle")
    ran = lambda names: F.arrays_overlap(F.col("tools"), F.array(*[F.lit(n) for n in names]))
    due = F.coalesce((F.col("recommendation") == "proceed") & acts, F.lit(False)) & (fires < 2)
    return F.when(due & ~ran(BOUNDARY_TOOLS), "measure boundaries").when(due & ~ran(["primitives", "video_analysis"]) & (fires == 0) & ran(CHANNEL_TOOLS), "run primitives")


def span(item: Column, duration: Column) -> Column:
    """A timed item within [0, duration] and rounded to hundredths; null if nothing is left of it."""
    t0, t1 = F.greatest(F.coalesce(item["t_start"], F.lit(0.0)), F.lit(0.0)), F.least(F.coalesce(item["t_end"], duration), duration)
    return F.when(t1 > t0, item.withField("t_start", F.round(t0, 2)).withField("t_end", F.round(t1, 2)))


def normalized_annotation(rows: DataFrame, key: str) -> DataFrame:
    """key, phases, interactions, risk_states, outcome and qa of annotations in their normal form.

    rows: key, duration, phases (label, t_start, t_end), interactions (actors, type, t_start, t_end), risk_states, outcome, qa
    (question, answer). Phases need a label and a span; interactions keep what they say if only their span is bad.
    """
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    cut = F.filter(F.transform("phases", lambda p: span(p.withField("label", F.trim(p["label"])), F.col("duration"))), lambda p: p.isNotNull() & filled(p["label"]))
    by_start = F.transform(F.array_sort(F.transform(cut, lambda p, i: F.struct(p["t_start"].alias("t"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    untimed = lambda a: a.withField("t_start", F.lit(None).cast("double")).withField("t_end", F.lit(None).cast("double"))
    timed = lambda a: F.when(a["t_start"].isNull() & a["t_end"].isNull(), a).otherwise(F.coalesce(span(a, F.col("duration")), untimed(a)))
    acts = F.transform(F.filter("interactions", lambda a: (F.size(a["actors"]) > 0) & filled(a["type"])), timed)
    risks = F.array_sort(F.array_distinct(F.filter(F.transform("risk_states", lambda r: F.trim(r)), filled)))
    outcome = F.when(F.col("outcome").isin(OUTCOMES), F.col("outcome")).otherwise("unclear")
    return rows.select(key, by_start.alias("phases"), acts.alias("interactions"), risks.alias("risk_states"), outcome.alias("outcome"), F.filter("qa", lambda q: filled(q["question"]) & filled(q["answer"])).alias("qa"))


def shown_labels(segments: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """What a viewer shows of a clip: its captions and its distinct skills in order of name."""
    skills = segments.groupBy(key).agg(F.array_sort(F.collect_set(F.nullif("skill", F.lit("")))).alias("labels"), F.count("*").alias("n_segments"))
    return captions.join(skills, key, "left").select(key, F.coalesce("short", F.lit("")).alias("video_summary"), F.coalesce("medium", F.lit("")).alias("summary"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


EVENT = "struct<subject:string,motion_style:string,time_of_day:string,lighting:string,base_prompt:string>"


def director_events(rows: DataFrame, key: str, n: int, fallback: DataFrame) -> DataFrame:
    """key, event_id and the fields of the first n events of a director's response (key, events), with defaults.

    Events without a prompt are left out. Where fewer than n are left, rows of the fallback (place and the same fields) fill up;
    events are then numbered anew, else they keep the number that they had in the response.
    """
    text = lambda name, default: F.coalesce(f"e.{name}", F.lit(default)).alias(name)
    each = rows.select(key, F.posexplode(F.slice("events", 1, n)).alias("i", "e")).where(F.trim(F.coalesce("e.base_prompt", F.lit(""))) != "")
    own = each.select(key, "i", text("subject", "person"), text("motion_style", "natural pace"), text("time_of_day", "midday"), text("lighting", "natural light"), F.trim("e.base_prompt").alias("base_prompt"))
    counts = rows.select(key).join(own.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    wanted = counts.where(F.col("n") < n).select(key, F.explode(F.sequence(F.lit(0), (n - 1 - F.col("n")).cast("int"))).alias("place"))
    spare = wanted.join(fallback.withColumn("place", F.col("place").cast("int")), "place").withColumn("i", n + F.col("place")).drop("place")
    both = own.unionByName(spare).join(counts, key)
    place = F.when(F.col("n") < n, F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1).otherwise(F.col("i"))
    return both.withColumn("event_id", F.format_string("e%02d", place)).drop("i", "n")
