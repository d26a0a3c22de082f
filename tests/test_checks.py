"""The checks on small made-up clips: what must be found and what must not."""

import math
import random

import duckdb
import pytest

from motionlake.operators import checks, kinematics
from motionlake.schemas import TABLES, Thresholds

W, H, FPS, N = 1280, 720, 30.0, 60
DIAG = math.hypot(W, H)


def clip(spark, tracks, kpts=()):
    clips = spark.createDataFrame([(1, FPS, W, H, N)], TABLES["clips"])
    return spark.createDataFrame(list(tracks), TABLES["tracks"]), spark.createDataFrame(list(kpts), TABLES["kpts"]), clips


def box(track, path, size=60, person=False, frames=range(N)):
    for f in frames:
        if (at := path(f)) is not None:
            yield 1, person, track, "person" if person else "box", f, float(at[0]), float(at[1]), float(at[0] + size), float(at[1] + (330 if person else size))


def person(track, path, wrist=None, ankle=None, conf=0.9, frames=range(N)):
    """A box and its keypoints; wrist and ankle give other places of the left ones."""
    rows = list(box(track, path, 140, True, frames))
    points = []
    for _, _, _, _, f, x1, y1, x2, y2 in rows:
        places = {5: (x1 + 40, y1 + 60), 6: (x1 + 100, y1 + 60), 7: (x1 + 30, y1 + 110), 8: (x1 + 110, y1 + 110), 9: (x1 + 30, y1 + 160), 10: (x1 + 110, y1 + 160), 11: (x1 + 50, y1 + 170), 12: (x1 + 90, y1 + 170), 13: (x1 + 50, y1 + 250), 14: (x1 + 90, y1 + 250), 15: (x1 + 50, y2), 16: (x1 + 90, y2)}
        if wrist:
            places[9] = wrist(f)
        if ankle:
            places[15], places[16] = ankle(f)
        points += [(1, track, f, k, float(x), float(y), conf) for k, (x, y) in places.items()]
    return rows, points


def types(spark, tracks, kpts=(), th=Thresholds()):
    found = checks.union_all(checks.all_checks(*clip(spark, tracks, kpts), th)).collect()
    return {(v.type, v.track_id) for v in found}, found


def walking(track=1):
    return person(track, lambda f: (300 + 2 * f, 320))


def test_a_clean_scene_has_no_violations(spark):
    rows, kpts = walking()
    assert types(spark, rows + list(box(2, lambda f: (600, 500))), kpts)[0] == set()


def test_jump(spark):
    found, rows = types(spark, box(2, lambda f: (200, 400) if f < 30 else (800, 400)))
    assert ("trajectory_jump", 2) in found
    jump = next(v for v in rows if v.type == "trajectory_jump")
    assert list(jump.frames) == [29, 30] and jump.severity == 1.0


def test_a_moving_camera_is_no_jump(spark):
    pan = lambda x: (lambda f: (x + (200 if f >= 30 else 0), 300))
    tracks = [r for k in range(4) for r in box(k, pan(100 + 150 * k))]
    assert not {t for t, _ in types(spark, tracks)[0]} & {"trajectory_jump", "contact_incoherence"}


def test_disappearance_and_materialization(spark):
    found, _ = types(spark, box(2, lambda f: (300, 300) if f < 20 else (800, 300) if f > 30 else None))
    assert ("object_disappearance", 2) in found
    found, rows = types(spark, box(3, lambda f: (500, 300), frames=range(30, N)))
    assert ("object_materialization", 3) in found and [v.severity for v in rows] == [0.75]
    assert types(spark, box(3, lambda f: (2, 300), frames=range(30, N)))[0] == set()  # at the edge
    switched = [*box(3, lambda f: (500, 300), frames=range(30, N)), *box(4, lambda f: (505, 300), frames=range(28))]
    assert types(spark, switched)[0] == set()  # the tracker took one for another


def test_object_that_moves_by_itself(spark):
    rows, kpts = person(1, lambda f: (50, 320))
    found, _ = types(spark, rows + list(box(2, lambda f: (400 + 28 * f, 300), frames=range(25))), kpts)
    assert ("contact_incoherence", 2) in found
    carried, points = person(1, lambda f: (50, 320), wrist=lambda f: (430 + 28 * f, 330))
    found, _ = types(spark, carried + list(box(2, lambda f: (400 + 28 * f, 300), frames=range(25))), points)
    assert ("contact_incoherence", 2) not in found
    falling, _ = types(spark, rows + list(box(2, lambda f: (600, 28 * f), frames=range(20))), kpts)
    assert ("contact_incoherence", 2) not in falling


def test_floating_levitation_and_skating(spark):
    rows, kpts = walking()
    assert ("gravity_suspicion", 2) in types(spark, rows + list(box(2, lambda f: (1000, 100))), kpts)[0]
    up, points = person(3, lambda f: (600, 100), frames=range(10, 50))
    assert ("levitation", 3) in types(spark, rows + up, kpts + points)[0]
    slide, points = person(4, lambda f: (300, 320), ankle=lambda f: ((300 + 40 * f, 650), (380, 650)), frames=range(20))
    found, _ = types(spark, slide, points)
    assert ("foot_skate", 4) in found


def test_telekinesis(spark):
    rows, kpts = person(1, lambda f: (100, 320), wrist=lambda f: (150 + 20 * f, 300))
    found, _ = types(spark, rows + list(box(2, lambda f: (600 + 20 * f, 300), frames=range(25))), kpts)
    assert ("telekinesis_suspicion", 2) in found


def test_shape_changes(spark):
    def morph(f):
        return 1, False, 2, "box", f, 500.0, 300.0, 560.0 + (60 if f % 10 == 5 else 0), 360.0

    assert ("object_deformation", 2) in types(spark, [morph(f) for f in range(N)])[0]
    stretch, points = person(1, lambda f: (300, 320))
    points = [(e, t, f, k, x, y - (150 if k == 7 and f in (20, 21, 40) else 0), c) for e, t, f, k, x, y, c in points]
    assert ("body_deformation", 1) in types(spark, stretch, points)[0]


def test_scores(spark):
    rows = [(1, "trajectory_jump", 0.9, [1], "", False, 1, "box", "formal"), (1, "foot_skate", 0.6, [2], "", True, 2, "person", "formal"), (2, "foot_skate", 0.5, [1], "", True, 3, "person", "formal"), (2, "foot_skate", 0.7, [1], "", True, 3, "person", "formal"), (3, "new_kind", 0.5, [1], "", True, 3, "person", "semantic")]
    clips = spark.createDataFrame([(k, FPS, W, H, N) for k in range(1, 5)], TABLES["clips"])
    found = {r.episode_id: r for r in checks.clip_scores(spark.createDataFrame(rows, TABLES["violations"]), clips).collect()}
    assert found[1].score == pytest.approx(1 - 0.25 * 0.9 - 0.15 * 0.6) and not found[1].plausible and found[1].reason == "critical: trajectory_jump"
    assert found[2].score == pytest.approx(1 - 0.15 * 0.7) and found[2].plausible
    assert found[3].score == pytest.approx(0.95) and found[4].score == 1.0 and found[4].plausible


def test_hysteresis_and_runs(spark):
    values = [5, 1, 1, 1, 2, 4, 1, 1, 9, 1, 1, 1]
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    got = [r.contact for r in kinematics.hysteresis(rows, ["k"], "i", "v", 2.0, 3.0, 3).orderBy("i").collect()]
    assert got == [False, True, True, True, True, False, False, False, False, True, True, True]
    found = kinematics.runs(rows, ["k"], "i", rows.v < 3, 3).orderBy("first").collect()
    assert [(r["first"], r["last"], r.n) for r in found] == [(1, 4, 4), (9, 11, 3)]


def test_quantiles_and_roundings_have_the_digits_of_sql(spark):
    """A last digit moves rows over a limit or a rounding's half."""
    rng = random.Random(5)
    rows = [(key, round(rng.random() * 500, 2)) for key in range(60) for _ in range(rng.randrange(5, 60))]
    df = spark.createDataFrame(rows, "key long, y double")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (key BIGINT, y DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got = {r.key: (r.q, r.n) for r in kinematics.quantiles(df, ["key"], "y", 0.75, "q").collect()}
    assert got == {k: (q, n) for k, q, n in duck.execute("SELECT key, quantile_cont(y, 0.75), count(*) FROM t GROUP BY 1").fetchall()}
    eighth = sorted(r[0] for r in df.selectExpr("y / 8 AS y").select(kinematics.nearest("y", 4).alias("y")).collect())
    assert eighth == sorted(r[0] for r in duck.execute("SELECT round(y / 8, 4) FROM t").fetchall())


def test_quantiles_between_close_samples(spark):
    """The shares are those of SQL, down to the last digit, at each share that 0.9 makes."""
    rng = random.Random(7)
    rows = [(key, rng.random() * 3) for key in range(400) for _ in range(5 + key % 40)]
    df = spark.createDataFrame([*rows, (1000, 1e300), (1000, 1.5e300)], "key long, y double")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (key BIGINT, y DOUBLE)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got = {r.key: r.q for r in kinematics.quantiles(df, ["key"], "y", 0.9, "q").collect()}
    assert got.pop(1000) == pytest.approx(1.45e300)
    assert got == dict(duck.execute("SELECT key, quantile_cont(y, 0.9) FROM t GROUP BY 1").fetchall())


def test_a_score_that_is_a_half_is_rounded_up(spark):
    """0.2017675: added up one by one, the losses make 0.20176749999999988."""
    worst = {"trajectory_jump": 0.7324999999999999, "foot_skate": 0.63405, "object_disappearance": 0.85, "gravity_suspicion": 0.6, "levitation": 0.85, "telekinesis_suspicion": 0.8, "object_deformation": 0.85}
    clips = spark.createDataFrame([(1, FPS, W, H, N)], TABLES["clips"])
    for kinds in (list(worst), sorted(worst), sorted(worst, reverse=True)):
        rows = [(1, k, worst[k], [1], "", False, 1, "box", "formal") for k in kinds]
        found = checks.clip_scores(spark.createDataFrame(rows, TABLES["violations"]).coalesce(1), clips).select(kinematics.nearest("score", 6).alias("score"), "n_types").first()
        assert (found.score, found.n_types) == (0.201768, 7)


def test_distances_are_roots_of_sums(spark):
    moves = [0.3, 0.7, 1.1, 2.3, 3.9]
    df = spark.createDataFrame([(3.0 * m, 4.0 * m) for m in moves], "dx double, dy double")
    assert [r[0] for r in df.select(kinematics.distance(df.dx, df.dy)).collect()] == [math.sqrt(3.0 * m * (3.0 * m) + 4.0 * m * (4.0 * m)) for m in moves]
