"""Time series: timelines, resampling, as-of matching, smoothing, bins, limits, descriptors of trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

EXACT_S = 1e-6
MAX_GAP_S = 0.34


def canonical_timeline(rows: DataFrame, keys: list[str], duration: str, hz: float) -> DataFrame:
    """keys, i and t = i / hz for all t within the duration."""
    last = F.floor(F.col(duration) * hz + 1e-9)
    return rows.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).withColumn("t", F.col("i") / F.lit(float(hz)))


def bracket(targets: DataFrame, source: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """targets with before and after: the source rows (t and values) around each, at the same time counting as before.

    One shuffle and one sort for both: source and target rows go through the same window.
    """
    sample = F.struct(F.col(t).alias("t"), *values)
    extra = [c for c in targets.columns if c not in (*keys, t)]
    own = F.struct(*extra) if extra else F.struct(F.lit(0).alias("none"))
    both = targets.select(*keys, t, own.alias("__own"), F.lit(1).alias("__kind")).unionByName(
        source.select(*keys, t, sample.alias("__s"), F.lit(0).alias("__kind")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(t, "__kind")
    before = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(t), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"before": before, "after": after}).where("__kind = 1")
    return found.select(*keys, t, *[f"__own.{c}" for c in extra], "before", "after")


def resample_linear(targets: DataFrame, source: DataFrame, keys: list[str], t: str, value: str, max_gap_s: float = MAX_GAP_S) -> DataFrame:
    """keys, t, value, interpolated, valid. Out of range or across a longer gap: the sample before (else after), not valid."""
    rows = bracket(targets, source, keys, t, [value])
    b, a, at = F.col("before"), F.col("after"), F.col(t)
    exact_b, exact_a = F.abs(b["t"] - at) <= EXACT_S, F.abs(a["t"] - at) <= EXACT_S
    exact = F.coalesce(exact_b, F.lit(False)) | F.coalesce(exact_a, F.lit(False))
    between = b.isNotNull() & a.isNotNull() & (a["t"] - b["t"] <= max_gap_s + EXACT_S)
    share = F.try_divide(at - b["t"], a["t"] - b["t"])
    mixed = (1 - share) * b[value] + share * a[value]
    out = F.when(F.coalesce(exact_a, F.lit(False)), a[value]).when(F.coalesce(exact_b, F.lit(False)), b[value]).when(between, mixed).otherwise(F.coalesce(b[value], a[value]))
    return rows.select(*keys, t, out.alias(value), (~exact & between).alias("interpolated"), (exact | between).alias("valid"))


def resample_quaternion(targets: DataFrame, source: DataFrame, keys: list[str], t: str, q: str, max_gap_s: float = MAX_GAP_S) -> DataFrame:
    """keys, t, q, interpolated, valid: quaternions (structs) along the shorter arc; gaps and ends as in ``resample_linear``."""
    rows = bracket(targets, source, keys, t, [q])
    b, a, at = F.col("before"), F.col("after"), F.col(t)
    on = lambda s: F.coalesce(F.abs(s["t"] - at) <= EXACT_S, F.lit(False))
    exact = on(a) | on(b)
    between = F.coalesce(b.isNotNull() & a.isNotNull() & (a["t"] - b["t"] <= max_gap_s + EXACT_S), F.lit(False))
    mixed = G.slerp(b[q], a[q], F.coalesce(F.try_divide(at - b["t"], a["t"] - b["t"]), F.lit(0.0)))
    out = F.when(on(a), a[q]).when(on(b), b[q]).when(between, mixed).otherwise(F.coalesce(b[q], a[q]))
    return rows.select(*keys, t, out.alias(q), (~exact & between).alias("interpolated"), (exact | between).alias("valid"))


def resample_poses(targets: DataFrame, source: DataFrame, keys: list[str], t: str, values: list[str], conf: str, order: str, least: float = 0.5) -> DataFrame:
    """keys, t, values, conf and valid: all channels of each key at once; of rows at the same time the last by order counts.

    A row is valid if no gap is too long and the confidence there is at least ``least``.
    """
    last = source.groupBy(*keys, t).agg(*[F.max_by(c, order).alias(c) for c in (*values, conf)])
    rows = bracket(targets, last, keys, t, [*values, conf])
    b, a, at = F.col("before"), F.col("after"), F.col(t)
    on = lambda s: F.coalesce(F.abs(s["t"] - at) <= EXACT_S, F.lit(False))
    between = F.coalesce(a["t"] - b["t"] <= MAX_GAP_S + EXACT_S, F.lit(False))
    share = F.try_divide(at - b["t"], a["t"] - b["t"])
    channel = lambda c: F.when(on(a), a[c]).when(on(b), b[c]).when(between, (1 - share) * b[c] + share * a[c]).otherwise(F.coalesce(b[c], a[c])).alias(c)
    out = rows.select(*keys, t, *[channel(c) for c in (*values, conf)], (on(a) | on(b) | between).alias("valid"))
    return out.withColumn("valid", F.col("valid") & F.coalesce(F.col(conf) >= least, F.lit(False)))


def asof_nearest(targets: DataFrame, source: DataFrame, keys: list[str], t: str, values: list[str], tolerance: float) -> DataFrame:
    """targets with the values of the nearest source row within the tolerance, else null; of two as near, the earlier."""
    rows = bracket(targets, source, keys, t, values)
    b, a, at = F.col("before"), F.col("after"), F.col(t)
    pick = F.when(a.isNull() | (at - b["t"] <= a["t"] - at), b).otherwise(a)
    kept = rows.withColumn("__p", pick).withColumn("__p", F.when(F.abs(F.col("__p.t") - at) <= tolerance, F.col("__p")))
    return kept.select(*[c for c in rows.columns if c not in ("before", "after")], F.col("__p.t").alias("matched_t"), *[F.col(f"__p.{v}").alias(v) for v in values])


def densify(rows: DataFrame, keys: list[str], frame: str, values: list[str], max_gap: int) -> DataFrame:
    """Frames that are missing between two rows at most max_gap apart are filled in linearly; filled marks them."""
    w = Window.partitionBy(*keys).orderBy(frame)
    step = F.lead(frame).over(w) - F.col(frame)
    nexts = {f"__n_{v}": F.lead(v).over(w) for v in values}
    last = F.when((F.col("__step") > 1) & (F.col("__step") <= max_gap), F.col("__step") - 1).otherwise(0)
    wide = rows.withColumns({"__step": step, **nexts}).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    share = F.when(F.col("__k") == 0, F.lit(0.0)).otherwise(F.col("__k") / F.col("__step"))
    mixed = [F.when(F.col("__k") == 0, F.col(v)).otherwise((1 - share) * F.col(v) + share * F.col(f"__n_{v}")).alias(v) for v in values]
    return wide.select(*keys, (F.col(frame) + F.col("__k")).alias(frame), *mixed, (F.col("__k") > 0).alias("filled"))


def moving_average_edge(value: str, keys: list[str], order: str, win: int) -> Column:
    """Mean of an odd window; beyond the ends the first and last values repeat."""
    half = win // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = w.rowsBetween(-half, half)
    before = F.greatest(F.lit(0), half - (F.row_number().over(w) - 1))
    behind = F.greatest(F.lit(0), half - (F.count(F.lit(1)).over(whole) - F.row_number().over(w)))
    return (F.sum(value).over(near) + before * F.first(value).over(whole) + behind * F.last(value).over(whole)) / F.lit(float(2 * half + 1))


def moving_average_zero(value: str, keys: list[str], order: str, win: int = 5) -> Column:
    """Mean of an odd window; beyond the ends there are zeros."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(win // 2), win // 2)) / F.lit(float(win))


def fixed_bins(rows: DataFrame, keys: list[str], t: str, value: Column, width: float, duration: DataFrame, empty: float = 0.0, agg=F.avg) -> DataFrame:
    """keys, bin and the aggregate (the mean, or another function of a column) of each bin up to the duration (keys,
    duration); empty bins hold ``empty``."""
    n = F.greatest(F.ceil(F.col("duration") / width), F.lit(1))
    frame = duration.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("bin"))
    means = rows.groupBy(*keys, F.floor(F.col(t) / width).cast("long").alias("bin")).agg(agg(value).cast("double").alias("v"))
    return frame.join(means, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("v", F.lit(empty)).alias("v"))


def changepoints(bins: DataFrame, keys: list[str], order: str, value: str, factor: float = 1.5) -> DataFrame:
    """Rows whose step from the row before is larger than the mean step plus factor standard deviations."""
    w = Window.partitionBy(*keys)
    step = F.abs(F.col(value) - F.lag(value).over(w.orderBy(order)))
    rows = bins.withColumn("step", step).withColumn("limit", F.avg("step").over(w) + factor * F.stddev_pop("step").over(w))
    return rows.where(F.col("step") > F.col("limit"))


def path_descriptors(rows: DataFrame, keys: list[str], order: str, x: str, y: str, still: float = 1e-3) -> DataFrame:
    """n, length, net displacement, straightness and turns of over a right angle between moving samples."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = rows.withColumns({"dx": F.col(x) - F.lag(x).over(w), "dy": F.col(y) - F.lag(y).over(w)}).withColumn("d", F.hypot("dx", "dy"))
    moving = F.when(F.col("d") > still, F.struct("dx", "dy"))
    earlier = F.last(moving, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = F.coalesce((F.col("d") > still) & (F.col("dx") * F.col("e.dx") + F.col("dy") * F.col("e.dy") < 0), F.lit(False))
    found = steps.withColumn("e", earlier).withColumn("turn", turn).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"),
        F.hypot(F.max_by(x, order) - F.min_by(x, order), F.max_by(y, order) - F.min_by(y, order)).alias("net"),
        F.count_if("turn").alias("turns"),
    )
    return found.withColumn("straightness", F.coalesce(F.try_divide("net", "length"), F.lit(0.0)))


def velocity_limits(rows: DataFrame, keys: list[str], t: str, q: str, max_vel: float, max_acc: float) -> DataFrame:
    """rows with speed and acc, and whether they break the limits; both stand at the later row, acc is of the speeds."""
    w = Window.partitionBy(*keys).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    speed = F.when(dt > 0, F.abs(F.col(q) - F.lag(q).over(w)) / dt)
    rows = rows.withColumns({"__dt": dt, "speed": speed})
    acc = F.when(F.col("__dt") > 0, F.abs(F.col("speed") - F.lag("speed").over(w)) / F.col("__dt"))
    bad = lambda c, limit: F.coalesce(F.col(c) > limit, F.lit(False))
    return rows.withColumn("acc", acc).withColumns({"vel_spike": bad("speed", max_vel), "acc_spike": bad("acc", max_acc)}).drop("__dt")


def jitter(rows: DataFrame, keys: list[str], t: str, q: str) -> DataFrame:
    """Largest second difference over the square of the median step, for each key of three rows and more."""
    w = Window.partitionBy(*keys).orderBy(t)
    second = F.abs(F.lead(q).over(w) - 2 * F.col(q) + F.lag(q).over(w))
    steps = rows.withColumns({"second": second, "dt": F.lead(t).over(w) - F.col(t)})
    return steps.groupBy(*keys).agg(F.max("second").alias("top"), F.median("dt").alias("dt"), F.count("*").alias("n")).where("n >= 3 AND dt > 0").select(*keys, (F.col("top") / (F.col("dt") * F.col("dt"))).alias("jitter"))


def duty_factor(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of rows that aren't faster than the key's median."""
    middle = rows.groupBy(*keys).agg(F.median(value).alias("__m"))
    return rows.join(middle, keys).groupBy(*keys).agg((1 - F.avg((F.col(value) > F.col("__m")).cast("double"))).alias("duty"))


def flicker(rows: DataFrame, keys: list[str], order: str, p: Column) -> DataFrame:
    """Mean change of presence (p over one half) from row to row; 0 for a single row. The last digits of p, which depend on the order
    in which a mean was added up, don't take it over one half."""
    on = (F.round(p, 12) > 0.5).cast("int")
    step = F.abs(on - F.lag(on).over(Window.partitionBy(*keys).orderBy(order)))
    return rows.withColumn("__d", step).groupBy(*keys).agg(F.coalesce(F.avg("__d"), F.lit(0.0)).alias("flicker"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def every_nth(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Rows 0, k, 2k, ... of each key, with k = max(1, rows // most)."""
    w = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / most))
    rows = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__k": k})
    return rows.where(F.col("__i") % F.col("__k") == 0).drop("__i", "__k")


def evenly(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """At most k rows of each key, spread evenly from the first to the last."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    rows = rows.withColumns({"__i": (F.row_number().over(w.orderBy(order)) - 1).cast("long"), "__n": n})
    take = F.least(F.lit(k).cast("long"), F.col("__n"))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), take - 1), lambda j: F.floor(j * (F.col("__n") - 1) / F.greatest(take - 1, F.lit(1))))
    return rows.where(F.array_contains(wanted, F.col("__i"))).drop("__i", "__n")


def decimate(rows: DataFrame, keys: list[str], frame: str, ratio: float) -> DataFrame:
    """Frames kept when the rate falls by ratio >= 1: frame i stays if it is the floor of a multiple of the ratio."""
    k = F.ceil(F.col(frame) / ratio)
    return rows.where(F.floor(k * ratio) == F.col(frame))


def nearest_frame(t: str, fps: float, n: str) -> Column:
    """Frame of a time, half to even, within the clip."""
    return F.least(F.bround(F.col(t) * fps, 0).cast("long"), F.col(n) - 1)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, width: float) -> DataFrame:
    """Points with each interval of the same keys that holds them, both ends included.

    An interval stands in every block of time that it touches and a point in its own, so the join is on equality and
    long groups don't meet as a whole.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.withColumn("__cell", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("__cell", cell(t)).join(spread, [*keys, "__cell"]).where(F.col(t).between(F.col(start), F.col(end))).drop("__cell")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, other: str, reach: float) -> DataFrame:
    """Pairs of equal keys whose times differ by reach at most; blocks as wide as the reach, each right row in three."""
    spread = right.withColumn("__cell", F.explode(F.transform(F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)]), lambda d: d + F.floor(F.col(other) / reach).cast("long"))))
    return left.withColumn("__cell", F.floor(F.col(t) / reach).cast("long")).join(spread, [*keys, "__cell"]).where(F.abs(F.col(t) - F.col(other)) <= reach).drop("__cell")


def without_overlaps(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals by start, each cut to begin where those before it end; what is empty then goes."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.greatest(F.col(start), F.coalesce(F.max(end).over(w), F.col(start)))
    return rows.withColumn("__s", cut).where(F.col("__s") < F.col(end)).withColumn(start, F.col("__s")).drop("__s")
