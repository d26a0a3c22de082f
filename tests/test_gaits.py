"""A walking dog of known strides."""

import math

import pytest
from pyspark.sql import functions as F

from motionlake.operators import gaits as G

FPS = 20.0


def dog(clip, n=60, period=0.5, speed=40.0):
    """Body of 100 pixels that goes to the right; paws lift in diagonal pairs."""
    for i in range(n):
        t, at = i / FPS, speed * i / FPS
        points = {"back_base": (at + 50, 0.0), "tail_base": (at - 50, 0.0)}
        for leg, (thigh, knee, paw) in G.LEGS.items():
            x = 40.0 if leg[0] == "F" else -40.0
            swing = math.sin(2 * math.pi * (t / period + (0.5 if leg in ("FR", "RL") else 0.0)))
            points |= {thigh: (at + x, 10.0), knee: (at + x, 30.0), paw: (at + x + 5 * swing, 50.0 + 8 * swing)}
        for name, (u, v) in points.items():
            yield clip, i, t, name, u, v, 0.9


def test_a_trotting_dog(spark):
    rows = spark.createDataFrame([*dog(1), *dog(2, speed=0.0)], "clip long, frame long, t double, name string, u double, v double, conf double")
    found = {r.clip: r for r in G.gait_summary(rows, "clip", "long", FPS).collect()}
    assert found[1].period == pytest.approx(0.5) and found[1].speed == pytest.approx(0.4, abs=0.02) and found[1].gait == "trot"
    assert found[2].gait == "stand"
    phases = [found[1][leg] for leg in G.LEGS]
    assert phases[0] == pytest.approx(phases[3], abs=0.01) and phases[1] == pytest.approx(phases[2], abs=0.01)
    assert abs(phases[0] - phases[1]) == pytest.approx(0.5, abs=0.1)
    legs = G.leg_series(G.body_frames(rows, ["clip"]), ["clip"])
    one = G.leg_summary(legs, ["clip"]).where("clip = 1").collect()
    assert sum(r.reference for r in one) == 1 and all(r.duty == pytest.approx(0.5, abs=0.12) for r in one)
    row = legs.where("clip = 1 AND leg = 'FL' AND frame = 30").collect()[0]
    assert row.x == pytest.approx(0.4, abs=0.06) and row.conf == 0.9
    hips = F.struct(F.lit(0.2).alias("x"), F.lit(0.1).alias("y"), F.lit(0.0).alias("z"))
    targets = G.foot_targets(legs, ["clip"], hips, 0.3, 1.0, 1.0, 2.0).agg(F.min("z"), F.max("z"), F.avg("x"), F.max("y")).collect()[0]
    assert targets[0] == pytest.approx(-0.3) and targets[1] > -0.2 and targets[2] == pytest.approx(0.2) and targets[3] == 0.1


def test_missing_legs_and_anchors(spark):
    rows = spark.createDataFrame([r for r in dog(1) if not r[3].startswith("back_left") and r[3] != "back_base"] + [r for r in dog(3, 4) if r[3] == "tail_base"], "clip long, frame long, t double, name string, u double, v double, conf double")
    found = {r.clip: r for r in G.gait_summary(rows, "clip", "long", FPS).collect()}
    assert found[1].RL is None and found[3].period is None and found[3].gait == "stand"


def test_without_anchors_the_picture_is_the_frame(spark):
    """A clip without a fore anchor, one whose first anchor is seen too seldom, and one without thighs."""
    ddl = "clip long, frame long, t double, name string, u double, v double, conf double"
    rows = [r for r in dog(1) if r[3] != "back_base"]
    rows += [r for r in dog(2) if r[3] != "back_base" or r[1] % 3 == 0] + [(2, i, i / FPS, "neck_base", 60.0 + 2 * i, 0.0, 0.9) for i in range(60)]
    rows += [r for r in dog(3) if not r[3].endswith("thai")]
    frames = G.body_frames(spark.createDataFrame(rows, ddl), ["clip"])
    told = {(r.clip, r.frame): r for r in frames.collect()}
    assert not told[1, 5].framed and told[1, 5].body == 1.0 and tuple(told[1, 5].hips) == (0.0, 0.0)
    assert told[2, 5].framed and told[2, 3].fore.u == 66.0 and told[2, 3].body == pytest.approx(110)
    assert not told[3, 5].framed
    legs = {(r.leg, r.frame): r for r in G.leg_series(frames, ["clip"]).where("clip = 1").collect()}
    paw = {(r[3], r[1]): r for r in rows if r[0] == 1}
    mean = lambda k: sum(paw["front_left_paw", f][k] for f in range(28, 33)) / 5
    assert legs["FL", 30].x == pytest.approx(mean(4)) and legs["FL", 30].y == pytest.approx(-mean(5))
    summary = {r.clip: r for r in G.gait_summary(spark.createDataFrame(rows, ddl), "clip", "long", FPS).collect()}
    assert summary[1].speed == 0.0 and summary[1].gait == "stand" and summary[1].period == pytest.approx(0.5)
