"""The ten plausibility checks of a clip, its score and its verdict.

Each check is a DataFrame of violations: episode_id, type, severity, frames, is_person, track_id, label, gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BONES, L_ANKLE, L_HIP, L_SHOULDER, L_WRIST, OTHER_WEIGHT, R_ANKLE, R_HIP, R_SHOULDER, R_WRIST, WEIGHTS, Thresholds
from ..sources.shared import held
from .kinematics import TRACK, centers, distance, ground_line, quantiles, runs, velocities, with_diagonal, with_next

OUT = ["episode_id", "type", "severity", "frames", "is_person", "track_id", "label", "gate"]


def severity(ratio: Column) -> Column:
    """0.5 at the threshold, 1 from three times it on."""
    return F.least(F.greatest(0.5 + 0.25 * (ratio - 1.0), F.lit(0.5)), F.lit(1.0))


def as_violations(rows: DataFrame, kind: str, sev: Column) -> DataFrame:
    return rows.withColumns({"type": F.lit(kind), "severity": sev, "gate": F.lit("formal")}).select(*OUT)


def trajectory_jump(vel: DataFrame, th: Thresholds) -> DataFrame:
    bad = vel.where((F.col("speed") > th.jump_speed) & (F.col("speed") / F.col("fps") > th.jump_min_disp))
    return as_violations(bad.withColumn("frames", F.array("frame", F.col("frame") + 1)), "trajectory_jump", severity(F.col("speed") / th.jump_speed))


def wide_keypoints(kpts: DataFrame) -> DataFrame:
    """A row a person and frame; k: keypoint number -> (x, y, conf)."""
    return kpts.groupBy("episode_id", "track_id", "frame").agg(
        F.map_from_entries(F.collect_list(F.struct("kpt_idx", F.struct("x", "y", "conf").alias("p")))).alias("k")
    )


def body_deformation(persons: DataFrame, kpts: DataFrame, clips: DataFrame, th: Thresholds) -> DataFrame:
    at = lambda i: F.element_at("k", F.lit(i))
    hyp = lambda dx, dy: F.sqrt(dx * dx + dy * dy)
    middle = lambda a, b, c: (at(a)[c] + at(b)[c]) / 2
    torso = hyp(*[middle(L_SHOULDER, R_SHOULDER, c) - middle(L_HIP, R_HIP, c) for c in "xy"])
    sure = reduce(Column.__and__, [at(i)["conf"] > th.kpt_conf for i in (L_SHOULDER, R_SHOULDER, L_HIP, R_HIP)])
    bones = F.explode(F.array(*[F.struct(F.lit(n).alias("bone"), at(a).alias("a"), at(b).alias("b")) for a, b, n in BONES]))
    rows = (
        wide_keypoints(kpts)
        .join(with_diagonal(clips), "episode_id")
        .withColumns({"torso": torso, "sure": sure, "n_rows": F.count("*").over(Window.partitionBy("episode_id", "track_id"))})
        .where(F.col("n_rows") >= th.bone_min_samples)
        .withColumn("z", bones)
        .withColumn("length", hyp(F.col("z.a.x") - F.col("z.b.x"), F.col("z.a.y") - F.col("z.b.y")))
        .where(F.col("sure") & (F.col("z.a.conf") > th.kpt_conf) & (F.col("z.b.conf") > th.kpt_conf) & (F.least("torso", "length") > th.bone_min_len * F.col("diag")))
        .withColumn("norm", F.col("length") / F.greatest("torso", F.lit(1e-3)))
        .select("episode_id", "track_id", "frame", "z.bone", "norm")
    )
    key = ["episode_id", "track_id", "bone"]
    own = quantiles(rows, key, "norm", th.bone_ref_pct / 100, "ref").withColumnRenamed("n", "valid")
    excess = F.col("norm") / F.col("ref") - 1
    bad = (
        rows.join(own.where((F.col("valid") >= th.bone_min_samples) & (F.col("ref") >= 1e-3)), key)
        .where(excess > th.bone_stretch_tol)
        .groupBy(*key)
        .agg(F.max(excess).alias("worst"), F.sort_array(F.collect_list("frame")).alias("frames"))
        .where(F.size("frames") >= th.bone_min_events)
    )
    labels = persons.select("episode_id", "track_id", "label").distinct()
    found = bad.join(labels, ["episode_id", "track_id"]).withColumn("is_person", F.lit(True))
    return as_violations(found, "body_deformation", severity((F.col("worst") / th.bone_stretch_tol + 1) / 2))


def foot_skate(vel: DataFrame, kpts: DataFrame, ground: DataFrame, th: Thresholds) -> DataFrame:
    ankles = kpts.where(F.col("kpt_idx").isin(L_ANKLE, R_ANKLE))
    w = Window.partitionBy("episode_id", "track_id", "kpt_idx").orderBy("frame")
    steps = ankles.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame", "x", "y", "conf")}).where(
        (F.col("n_frame") == F.col("frame") + 1) & (F.col("conf") >= th.kpt_conf) & (F.col("n_conf") >= th.kpt_conf)
    )
    moved = vel.where("is_person").select("episode_id", "track_id", "frame", "label", "cam_x", "cam_y", "diag", "fps").join(steps, ["episode_id", "track_id", "frame"]).join(ground, "episode_id")
    rate = lambda c: F.abs(F.col(f"n_{c}") - F.col(c) - F.col(f"cam_{c}")) / F.col("diag") * F.col("fps")
    rows = moved.withColumns({"fx": rate("x"), "fy": rate("y"), "is_person": F.lit(True)})
    flag = (F.abs(F.col("y") - F.col("ground_y")) < th.ground_band * F.col("diag")) & (F.col("fy") < th.skate_max_vy) & (F.col("fx") > th.skate_min_vx)
    found = runs(rows, [*TRACK, "kpt_idx"], "frame", flag, th.skate_min_frames, worst=F.max("fx"), label=F.first("label"))
    return as_violations(found, "foot_skate", severity(F.col("worst") / th.skate_min_vx) * 0.9)


def wrists(kpts: DataFrame, th: Thresholds) -> DataFrame:
    found = kpts.where(F.col("kpt_idx").isin(L_WRIST, R_WRIST) & (F.col("conf") >= th.kpt_conf))
    return found.select("episode_id", "frame", F.col("track_id").alias("person"), F.col("kpt_idx").alias("wrist"), F.col("x").alias("wx"), F.col("y").alias("wy"))


def box_distance(x: Column, y: Column) -> Column:
    """Of a point to the row's box."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(F.col("x1") - x, zero, x - F.col("x2")), F.greatest(F.col("y1") - y, zero, y - F.col("y2"))
    return F.sqrt(dx * dx + dy * dy)


def contact_incoherence(vel: DataFrame, kpts: DataFrame, tracks: DataFrame, th: Thresholds) -> DataFrame:
    """Objects that move with no hand near and aren't falling; only in clips that have a person."""
    staffed = tracks.where("is_person").select("episode_id").distinct()
    falling = (F.col("vy") > 0) & (F.col("vy") / F.greatest("speed", F.lit(1e-6)) > th.fall_vy_ratio)
    objects = vel.where(~F.col("is_person")).join(staffed, "episode_id", "left_semi").withColumn("moving", (F.col("speed") > th.carried_min_speed) & ~falling)
    near = (
        objects.where("moving").join(wrists(kpts, th), ["episode_id", "frame"]).groupBy(*TRACK, "frame").agg(F.min(box_distance(F.col("wx"), F.col("wy"))).alias("dist"))
    )
    rows = objects.join(near, [*TRACK, "frame"], "left")
    far = F.coalesce(F.col("dist") / F.col("diag") > th.contact_dist, F.lit(True))
    found = runs(rows, TRACK, "frame", F.col("moving") & far, th.contact_min_frames, worst=F.max("speed"), label=F.first("label"))
    return as_violations(found, "contact_incoherence", severity(F.col("worst") / th.carried_min_speed) * 0.9)


def object_disappearance(tracks: DataFrame, clips: DataFrame, th: Thresholds) -> DataFrame:
    rows = with_next(tracks).join(with_diagonal(clips), "episode_id")
    gap = F.col("next_frame") - F.col("frame") - 1
    disp = distance(F.col("next_cx") - F.col("cx"), F.col("next_cy") - F.col("cy")) / F.col("diag")
    bad = rows.withColumns({"gap": gap, "disp": disp}).where(
        (F.col("gap") >= F.greatest(F.lit(th.persist_min_gap), F.floor(th.persist_gap_s * F.col("fps")))) & (F.col("disp") > th.persist_reappear_disp)
    )
    return as_violations(bad.withColumn("frames", F.array("frame", "next_frame")), "object_disappearance", severity(F.col("disp") / th.persist_reappear_disp) * 0.85)


def near_same_frame(rows: DataFrame, persons: DataFrame, radius: float) -> DataFrame:
    """TRACK and frame of the rows that have a person nearer than the radius in the same frame."""
    p = persons.select("episode_id", "frame", F.col("cx").alias("px"), F.col("cy").alias("py"))
    return rows.join(p, ["episode_id", "frame"]).where(distance(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")) / F.col("diag") < radius).select(*TRACK, "frame").distinct()


def gravity_suspicion(vel: DataFrame, tracks: DataFrame, ground: DataFrame, th: Thresholds) -> DataFrame:
    objects = vel.where(~F.col("is_person")).join(ground, "episode_id")
    objects = objects.withColumns(
        {
            "still": (F.col("ground_y") - F.col("y2") >= th.float_ground_clearance * F.col("diag")) & (F.col("speed") <= th.float_max_speed),
            "least": F.greatest(F.lit(2), F.floor(th.float_min_s * F.col("fps"))),
        }
    )
    near = near_same_frame(objects.where("still"), centers(tracks.where("is_person")), th.float_person_dist).withColumn("near", F.lit(True))
    rows = objects.join(near, [*TRACK, "frame"], "left")
    found = runs(rows, [*TRACK, "least"], "frame", F.col("still") & F.col("near").isNull(), F.col("least"), label=F.first("label"))
    return as_violations(found, "gravity_suspicion", F.lit(0.6))


def track_ends(tracks: DataFrame) -> DataFrame:
    """First and last row of each track."""
    part = lambda c: F.struct("frame", "cx", "cy", "x1", "y1", "x2", "y2").alias(c)
    return centers(tracks).withColumn("at", part("at")).groupBy(*TRACK, "label").agg(F.min_by("at", "frame").alias("head"), F.max_by("at", "frame").alias("tail"))


def near_edge(at: str, margin: float) -> Column:
    c = lambda n: F.col(f"{at}.{n}")
    return (c("x1") < margin * F.col("width")) | (c("y1") < margin * F.col("height")) | (c("x2") > (1 - margin) * F.col("width")) | (c("y2") > (1 - margin) * F.col("height"))


def object_materialization(tracks: DataFrame, clips: DataFrame, th: Thresholds) -> DataFrame:
    """Tracks that begin or end amid the clip and the frame, with no person near and no other track to take over.

    Persons are looked for in the two rows around the frame, at most two frames away: with their next row beside each
    row, that is an equality on the frame rounded to blocks. Other tracks' ends are matched on blocks of frames as wide as the
    longest gap, a row standing in its own block and both neighbours.
    """
    ends = track_ends(tracks).join(with_diagonal(clips), "episode_id")
    margin, gap = F.floor(th.mater_margin_s * F.col("fps")), F.greatest(F.lit(2), F.floor(th.idswitch_gap_s * F.col("fps")))
    heads = ends.where((F.col("head.frame") > margin) & ~near_edge("head", th.edge_margin)).select(*TRACK, "label", "diag", gap.alias("gap"), F.lit("head").alias("end"), "head.frame", "head.cx", "head.cy")
    tails = ends.where((F.col("tail.frame") < F.col("n_frames") - margin) & ~near_edge("tail", th.edge_margin)).select(*TRACK, "label", "diag", gap.alias("gap"), F.lit("tail").alias("end"), "tail.frame", "tail.cx", "tail.cy")
    found = heads.unionByName(tails)
    key = [*TRACK, "end"]
    w = Window.partitionBy("episode_id", "track_id").orderBy("frame")
    persons = centers(tracks.where("is_person")).select("episode_id", F.col("track_id").alias("other"), F.col("frame").alias("pf"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.lag("frame").over(w).alias("before"), F.lead("frame").over(w).alias("after"))
    offsets = lambda n: F.explode(F.sequence(F.col("frame") - n, F.col("frame") + n))
    close = distance(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")) / F.col("diag")
    # The row at or after the frame, and the one before it: of a person's rows at most these two.
    beside = ((F.col("pf") >= F.col("frame")) & (F.coalesce("before", F.lit(-1)) < F.col("frame"))) | ((F.col("pf") < F.col("frame")) & (F.coalesce("after", F.col("frame")) >= F.col("frame")))
    near = (
        found.withColumn("pf", offsets(2))
        .join(persons, ["episode_id", "pf"])
        .where(beside & ~(F.col("is_person") & (F.col("other") == F.col("track_id"))) & (close < th.mater_person_dist))
        .select(*key)
        .distinct()
    )
    other = ends.select("episode_id", F.col("track_id").alias("other"), F.explode(F.array(
        F.struct(F.lit("head").alias("end"), F.col("tail.frame").alias("pf"), F.col("tail.cx").alias("px"), F.col("tail.cy").alias("py")),
        F.struct(F.lit("tail").alias("end"), F.col("head.frame").alias("pf"), F.col("head.cx").alias("px"), F.col("head.cy").alias("py")),
    )).alias("o")).select("episode_id", "other", "o.*")
    switched = (
        found.withColumn("pf", offsets(F.col("gap")))
        .join(other, ["episode_id", "end", "pf"])
        .where((F.col("other") != F.col("track_id")) & (close < th.idswitch_dist))
        .select(*key)
        .distinct()
    )
    left = found.join(near, key, "left_anti").join(switched, key, "left_anti").withColumn("frames", F.array("frame"))
    return as_violations(left, "object_materialization", F.when(F.col("end") == "head", 0.75).otherwise(0.70))


def levitation(vel: DataFrame, kpts: DataFrame, ground: DataFrame, th: Thresholds) -> DataFrame:
    ankles = kpts.where(F.col("kpt_idx").isin(L_ANKLE, R_ANKLE)).groupBy("episode_id", "track_id", "frame").agg(F.max("y").alias("low"), F.min("conf").alias("sure"))
    rows = vel.where("is_person").join(ankles.where(F.col("sure") >= th.kpt_conf), ["episode_id", "track_id", "frame"]).join(ground, "episode_id")
    rows = rows.withColumn("least", F.greatest(F.lit(3), F.floor(th.levit_min_s * F.col("fps"))))
    flag = (F.col("ground_y") - F.col("low") > th.levit_clearance * F.col("diag")) & (F.abs("vy") < th.levit_max_vy)
    found = runs(rows, [*TRACK, "least"], "frame", flag, F.col("least"), label=F.first("label"))
    return as_violations(found, "levitation", F.lit(0.85))


def telekinesis(vel: DataFrame, kpts: DataFrame, th: Thresholds) -> DataFrame:
    """Objects that follow a distant wrist: the nearest one, and that same one a frame later."""
    objects = vel.where(~F.col("is_person"))
    hands = wrists(kpts, th)
    dist = distance(F.col("wx") - F.col("cx"), F.col("wy") - F.col("cy"))
    nearest = (
        objects.where(F.col("speed") >= th.tk_min_speed)
        .join(hands, ["episode_id", "frame"])
        .groupBy(*TRACK, "frame")
        .agg(F.min(F.struct(dist.alias("dist"), F.col("person"), F.col("wrist"), F.col("wx"), F.col("wy"))).alias("h"))
    )
    later = hands.select("episode_id", (F.col("frame") - 1).alias("frame"), F.col("person").alias("__p"), F.col("wrist").alias("__w"), F.col("wx").alias("lx"), F.col("wy").alias("ly"))
    rows = objects.join(nearest, [*TRACK, "frame"], "left").withColumns({"__p": F.col("h.person"), "__w": F.col("h.wrist")}).join(later, ["episode_id", "frame", "__p", "__w"], "left")
    hx, hy = ((F.col(f"l{c}") - F.col(f"h.w{c}") - F.col(f"cam_{c}")) / F.col("diag") * F.col("fps") for c in "xy")
    rows = rows.withColumns({"hx": hx, "hy": hy}).withColumn("hn", distance(F.col("hx"), F.col("hy")))
    along = F.col("hx") * F.col("vx") + F.col("hy") * F.col("vy")
    flag = (F.col("h.dist") / F.col("diag") >= th.tk_dist) & (F.col("hn") >= 0.1) & (F.col("speed") >= 1e-6) & (along > th.tk_corr * F.col("hn") * F.col("speed"))
    found = runs(rows, TRACK, "frame", flag, th.tk_min_frames, label=F.first("label"))
    return as_violations(found, "telekinesis_suspicion", F.lit(0.8))


def object_deformation(tracks: DataFrame, th: Thresholds) -> DataFrame:
    aspect = F.log(F.greatest(F.col("x2") - F.col("x1"), F.lit(1e-3)) / F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-3)))
    w = Window.partitionBy(*TRACK).orderBy("frame")
    step = F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.abs(F.col("aspect") - F.lag("aspect").over(w)))
    bad = (
        tracks.where(~F.col("is_person"))
        .withColumn("aspect", aspect)
        .withColumn("step", step)
        .where(F.col("step") > th.deform_log_aspect)
        .groupBy(*TRACK, "label")
        .agg(F.max("step").alias("worst"), F.sort_array(F.collect_list("frame")).alias("frames"))
        .where(F.size("frames") >= th.deform_min_events)
    )
    return as_violations(bad, "object_deformation", severity(F.col("worst") / th.deform_log_aspect) * 0.85)


def all_checks(tracks: DataFrame, kpts: DataFrame, clips: DataFrame, th: Thresholds = Thresholds(), shared: bool = False) -> dict[str, DataFrame]:
    """Violations by check, in the order in which the checks count.

    shared: the velocities that most checks read are kept in memory and on disk, so they are made once for all checks,
    until they are made of another table; what is lost with an executor is made again.
    """
    vel, ground = velocities(tracks, clips), ground_line(kpts, th)
    if shared:
        vel = held(vel, "velocities")
    return {
        "trajectory_jump": trajectory_jump(vel, th),
        "body_deformation": body_deformation(tracks.where("is_person"), kpts, clips, th),
        "foot_skate": foot_skate(vel, kpts, ground, th),
        "contact_incoherence": contact_incoherence(vel, kpts, tracks, th),
        "object_disappearance": object_disappearance(tracks, clips, th),
        "gravity_suspicion": gravity_suspicion(vel, tracks, ground, th),
        "object_materialization": object_materialization(tracks, clips, th),
        "levitation": levitation(vel, kpts, ground, th),
        "telekinesis_suspicion": telekinesis(vel, kpts, th),
        "object_deformation": object_deformation(tracks, th),
    }


def union_all(found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found.values())


def check_order() -> Column:
    """Place of a type among the checks; breaks ties of severity."""
    names = list(WEIGHTS)
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("type")), F.lit(0)), F.lit(len(names) + 1))


def weight(kind: str = "type") -> Column:
    table = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(OTHER_WEIGHT))


def precise_sum(values: Column) -> Column:
    """Of a short array: what each addition loses is kept beside the total and added at the end."""

    def add(total: Column, x: Column) -> Column:
        s, t = total["s"], total["s"] + x
        return F.struct(t.alias("s"), (total["c"] + F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda total: total["s"] + total["c"])


def clip_scores(violations: DataFrame, clips: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """episode_id, score, n_violations, n_types, critical, plausible, reason: only the worst of each type counts. The loss doesn't depend on the order in which they are added up."""
    worst = violations.groupBy("episode_id", "type").agg(F.max("severity").alias("worst"), F.count("*").alias("n"))
    order = F.struct((-F.col("worst")).alias("s"), check_order().alias("o"), F.col("type"), F.col("worst"))
    rolled = worst.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct(check_order().alias("o"), F.col("type"), (weight() * F.col("worst")).alias("loss")))).alias("losses"), F.sum("n").alias("n_violations"), F.count("*").alias("n_types"), F.min(order).alias("top"), F.sort_array(F.collect_set("type")).alias("types")
    )
    rows = clips.select("episode_id").join(rolled, "episode_id", "left")
    loss = precise_sum(F.transform("losses", lambda x: x["loss"]))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(loss, F.lit(0.0))))
    critical = F.coalesce(F.col("top.worst") > th.critical_severity, F.lit(False))
    plausible = (F.col("score") >= th.accept_score) & ~F.col("critical")
    reason = F.when(F.col("plausible"), "no critical inconsistency").when(F.col("critical"), F.concat(F.lit("critical: "), "top.type")).otherwise(F.array_join("types", ", "))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        rows.withColumns({"score": score, "critical": critical})
        .withColumn("plausible", plausible)
        .select("episode_id", "score", zero("n_violations"), zero("n_types"), "critical", "plausible", reason.alias("reason"))
    )


def top_violations(violations: DataFrame, n: int = 8) -> DataFrame:
    """The n worst violations of each clip; ties by check, then track and first frame."""
    w = Window.partitionBy("episode_id").orderBy(F.desc("severity"), check_order(), "track_id", F.element_at("frames", 1), F.array_join("frames", ","))
    return violations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def evidence_summary(tracks: DataFrame, violations: DataFrame) -> DataFrame:
    """Counts and sets of each clip's tracks and violations."""
    one = tracks.groupBy(*TRACK, "label").agg(F.count("*").alias("n"))
    seen = one.groupBy("episode_id").agg(
        F.count_if("is_person").alias("n_persons"), F.count_if(~F.col("is_person")).alias("n_objects"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("is_person"), F.col("label")))), ",").alias("object_labels")
    )
    frames = violations.select("episode_id", F.explode("frames").alias("f")).groupBy("episode_id").agg(F.count_distinct("f").alias("n_suspicious"))
    formal = violations.groupBy("episode_id").agg(F.count_if(F.col("gate") == "formal").alias("n_formal"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(frames, "episode_id", "left").join(formal, "episode_id", "left").select("episode_id", "n_persons", "n_objects", "object_labels", zero("n_suspicious"), zero("n_formal"))

