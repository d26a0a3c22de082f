"""Checks and normal forms of documents: contracts of tables, findings, labels, scenarios, captions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import SOURCES, Thresholds

FINDING = "type string, severity double, frames array<int>, reason string"
FINDING_TYPES = ["anatomical_anomaly", "magic_effect", "object_morphing", "impossible_gesture", "scene_inconsistency", "prompt_mismatch"]


def contract_violations(rows: DataFrame, required: list[str], keys: list[str], t: str = "t") -> DataFrame:
    """rule and n: missing columns, confidences out of [0, 1], unknown sources, times that don't rise within the keys."""
    missing = [c for c in required if c not in rows.columns]
    rules = [(f"missing column {c}", F.lit(1)) for c in missing]
    checks: list[tuple[str, Column]] = []
    for c in rows.columns:
        if c == "conf" or c.endswith("_conf"):
            checks.append((f"{c} outside [0, 1]", ~F.coalesce(F.col(c).between(0, 1) & ~F.isnan(F.col(c).cast("double")), F.lit(False))))
        if c.endswith("source"):
            checks.append((f"unknown {c}", ~F.coalesce(F.col(c).isin(SOURCES), F.lit(False))))
    seen = rows
    if t in rows.columns:
        order = [c for c in ("frame", t) if c in rows.columns]
        seen = rows.withColumn("__late", F.col(t) <= F.lag(t).over(Window.partitionBy(*keys).orderBy(*order)))
        checks.append((f"{t} doesn't rise", F.coalesce(F.col("__late"), F.lit(False))))
    one = seen.agg(F.count("*").alias("__n"), *[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(checks)])
    told = [F.struct(F.lit(r).alias("rule"), n.cast("long").alias("n")) for r, n in rules] + [F.struct(F.lit(r).alias("rule"), F.col(f"c{i}").alias("n")) for i, (r, _) in enumerate(checks)]
    return one.select(F.explode(F.array(*told)).alias("x")).select("x.*").where("n > 0") if told else one.select(F.lit("").alias("rule"), F.lit(0).cast("long").alias("n")).limit(0)


def parse_findings(replies: DataFrame, key: str, reply: str, th: Thresholds = Thresholds()) -> DataFrame:
    """A reviewer's findings: of known types and severe enough, their severity scaled down and capped, worst first."""
    rows = replies.select(key, F.posexplode(F.from_json(X.json_of_reply(F.col(reply)), f"findings array<struct<{FINDING}>>")["findings"]).alias("at", "f"))
    sev = F.least(F.greatest(F.col("f.severity"), F.lit(0.0)), F.lit(1.0))
    frames = F.array_sort(F.array_distinct(F.filter(F.coalesce("f.frames", F.array().cast("array<int>")), lambda x: x >= 0)))
    return rows.where(F.col("f.type").isin(FINDING_TYPES) & (sev >= th.gate2_min_severity)).select(
        key,
        F.col("f.type").alias("type"),
        F.least(sev * th.gate2_scale, F.lit(th.gate2_cap)).alias("severity"),
        F.when(F.size(frames) == 0, F.array(F.lit(0))).otherwise(frames).alias("frames"),
        F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sev), "at")).alias("place"),
    )


def duplicate_ids(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Rows that repeat an id of an earlier row of their group."""
    w = Window.partitionBy(*keys, name).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k > 1").drop("__k")


#: Rows of one partition of pairs: what a task holds of them doesn't grow with the table.
PART_ROWS = 1_000_000


def set_errors(locked: DataFrame, referenced: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, missing (locked, not referenced) and unknown (referenced, not locked), each sorted.

    A pair is told by one aggregate over both sides, in as many partitions as their rows ask for; only pairs that lack a side go on.
    """
    sides = locked.select(*keys, name, F.lit(True).alias("l")).unionByName(referenced.select(*keys, name, F.lit(True).alias("r")), allowMissingColumns=True)
    parts = max(sides.sparkSession.sparkContext.defaultParallelism, math.ceil(sides.count() / PART_ROWS))
    one = sides.repartition(parts, *keys, name).groupBy(*keys, name).agg(F.max("l").alias("l"), F.max("r").alias("r")).where(F.col("l").isNull() | F.col("r").isNull())
    lacks = lambda side: F.sort_array(F.collect_list(F.when(F.col(side).isNull(), F.col(name))))
    found = one.groupBy(*keys).agg(lacks("r").alias("missing"), lacks("l").alias("unknown"))
    return found.where((F.size("missing") > 0) | (F.size("unknown") > 0))


def clean_spans(rows: DataFrame, start: str, end: str, duration: str) -> DataFrame:
    """Spans held within [0, duration] and rounded to hundredths; what is empty then goes."""
    hold = lambda c: F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(duration)), 2)
    return rows.withColumns({start: hold(start), end: hold(end)}).where(F.col(start) < F.col(end))


def apply_gates(metrics: DataFrame, gates: list[tuple[str, str, float, bool]]) -> DataFrame:
    """passed and reasons of each row; a gate is (metric, ge or le, threshold, required); missing metrics fail if required."""
    tests = []
    for name, kind, limit, required in gates:
        ok = F.col(name) >= limit if kind == "ge" else F.col(name) <= limit
        tests.append(F.when(F.col(name).isNull(), F.lit(f"{name} is missing") if required else None).when(~ok, F.lit(f"{name} {'below' if kind == 'ge' else 'above'} {limit:g}")))
    reasons = F.filter(F.array(*tests), lambda r: r.isNotNull())
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def captions(segments: DataFrame, keys: list[str], order: str, skill: str) -> DataFrame:
    """Distinct skills but idle in order of first use, as a sentence, and how many segments have each."""
    used = segments.where(F.col(skill) != "idle").groupBy(*keys, skill).agg(F.min(order).alias("at"), F.count("*").alias("n"))
    found = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", skill, "n"))).alias("s"))
    names = F.transform("s", lambda x: x[skill])
    counts = F.transform("s", lambda x: F.concat_ws(":", x[skill], x["n"]))
    return found.select(*keys, F.array_join(names, ", then ").alias("caption"), F.array_join(counts, ",").alias("counts"))


def first_non_empty(*names: str) -> Column:
    return F.coalesce(*[F.when(F.length(F.trim(n)) > 0, F.col(n)) for n in names])


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
