"""Fused channels against numpy, and primitives of made-up motion from start to end."""

import numpy as np
from pyspark.sql import functions as F

from motionlake.operators import fusion as S
from motionlake.operators.series import flicker

DDL = "clip string, channel string, hold boolean, t double, v double"


def test_grid_equals_numpy(spark):
    draw = np.random.default_rng(4)
    durations = {"a": 3.0, "b": 0.05, "c": 0.7, "d": 12.34}
    rows, want = [], {}
    for clip, duration in durations.items():
        grid = np.arange(0.0, max(duration, 0.2), 0.1)
        for channel, n, hold in (("one", 1, True), ("few", 4, False), ("many", 200, True), ("late", 3, False)):
            t = np.unique(draw.uniform(-0.3, duration + 0.5, n)) + (duration if channel == "late" else 0)
            v = draw.normal(size=n)
            rows += [(clip, channel, hold, float(a), float(b)) for a, b in zip(t, v)]
            want[clip, channel] = np.interp(grid, t, v) if hold else np.interp(grid, t, v, left=0.0, right=0.0)
    samples = spark.createDataFrame([*rows, ("a", "one", True, None, 1.0), ("a", "one", True, 2.0, None), ("z", "one", True, 1.0, 1.0)], DDL)
    clips = spark.createDataFrame(list(durations.items()), "clip string, duration double")
    got = {}
    for r in S.on_grid(samples, clips, ["clip"]).orderBy("clip", "channel", "i").collect():
        assert r.t == r.i * 0.1
        got.setdefault((r.clip, r.channel), []).append(r.v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert len(got[k]) == len(v) and np.allclose(got[k], v), (k, len(got[k]), len(v), got[k][:5], v[:5])


def test_smoothing_takes_quadratics_as_they_are():
    x = np.arange(12.0)
    assert np.allclose(S.smoothed(np.column_stack([3 * x * x - x, 0 * x + 2])), np.column_stack([3 * x * x - x, 0 * x + 2]))
    noisy = np.random.default_rng(1).normal(size=(30, 1))
    kernel = np.array([-2, 3, 6, 7, 6, 3, -2]) / 21  # quadratics over seven samples, at their middle
    assert np.allclose(S.smoothed(noisy)[3:-3, 0], np.convolve(noisy[:, 0], kernel, "valid"))


def test_primitives_of_made_up_motion(spark):
    """Still, then the wrist moves, then the whole picture: three segments, named by what moves."""
    rows = []
    for i in range(90):
        t, noise = i / 10, ((i * 7919) % 13 - 6) / 100
        rows.append(("clip", "flow", True, t, 0.1 + noise + (8.0 if t >= 6 else 0.0)))
        rows.append(("clip", "wrist", False, t, 0.2 + noise + (5.0 if 3 <= t < 6 else 0.0)))
    samples = spark.createDataFrame([*rows, *[("still", "flow", True, i / 10, 0.3) for i in range(40)], ("short", "wrist", False, 0.1, 1.0)], DDL)
    clips = spark.createDataFrame([("clip", 9.0), ("still", 4.0), ("short", 0.3)], "clip string, duration double")
    grid = S.on_grid(samples, clips, ["clip"])
    found = S.primitives(grid, "clip", ["flow", "wrist", "hands"], "flow").orderBy("clip", "place").collect()
    moved = [r for r in found if r.clip == "clip"]
    assert [(r.place, r.activity, r.dominant) for r in moved][1:] == [(1, "static", "wrist"), (2, "high_motion", "flow")] and moved[0].activity == "static"
    assert abs(moved[0].end_s - 3.0) <= 0.2 and abs(moved[1].end_s - 6.0) <= 0.2 and moved[0].start_s == 0 and moved[2].end_s == 8.9
    assert abs(moved[1].means["wrist"] - 5.2) < 0.1 and set(moved[1].means) == {"flow", "wrist"}
    assert [(r.place, r.start_s, r.end_s, r.activity, round(r.level, 6)) for r in found if r.clip == "still"] == [(0, 0.0, 3.9, "static", 0.3)]
    assert [(r.start_s, r.end_s, r.activity, r.level) for r in found if r.clip == "short"] == [(0.0, 0.2, "static", 0.0)]


def test_activity_levels(spark):
    rows = spark.createDataFrame([(5.0, 4.0), (3.0, 4.0), (0.9, 4.0), (0.6, 0.0), (0.4, 0.0)], "level double, high double")
    assert [r[0] for r in rows.select(S.activity(F.col("level"), F.col("high"))).collect()] == ["high_motion", "low_motion", "static", "low_motion", "static"]


def test_speeds(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 3.0, 4.0), (1, 1.0, 3.0, 4.0), (2, 0.0, 1.0, 1.0)], "clip long, t double, x double, y double")
    assert sorted(tuple(r) for r in S.speeds(rows, ["clip"], "t", ["x", "y"], 2).collect()) == [(1, 1.0, 0.0), (1, 1.0, 5.0)]


def test_levels_have_the_same_digits_in_any_order(spark):
    cells = [("a", "one", i, v) for i, v in enumerate([0.1, 0.2, 0.3])]
    for rows in (cells, cells[::-1]):
        grid = spark.createDataFrame(rows, "clip string, channel string, i long, v double").coalesce(1).withColumn("part", F.lit(0))
        assert [r.level for r in S.segment_levels(grid, ["clip"], "part", "one").collect()] == [(0.3 + 0.2 + 0.1) / 3]


def test_last_digits_of_a_mean_are_no_presence(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5000000000000001), (1, 2, 0.5), (2, 0, 0.5), (2, 1, 0.51)], "k long, i long, p double")
    assert {r.k: r.flicker for r in flicker(rows, ["k"], "i", F.col("p")).collect()} == {1: 0.0, 2: 1.0}
