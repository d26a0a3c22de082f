"""Seeded expansion, output hashes, layouts: cases by hand."""

import hashlib

from motionlake.operators import expansion as X


def test_expansion_is_told_by_its_seed(spark):
    jobs = spark.createDataFrame([(1, "walk", None, 3), (2, "walk", None, 0), (3, "run", 7, 1), (4, "sit", 7, None)], "job int, prompt string, seed int, cameras int")
    rows = {(r.job, r.event_id): r for r in X.expanded_events(jobs, 12).collect()}
    again = {(r.job, r.event_id): r for r in X.expanded_events(jobs.repartition(3), 12).collect()}
    assert rows == again and len(rows) == 48
    same = lambda a, b: all(rows[a, f"e{i:02}"].motion_style == rows[b, f"e{i:02}"].motion_style for i in range(12))
    assert same(1, 2) and same(3, 4) and not same(1, 3)
    assert {r.lighting == X.NIGHT_LIGHT for r in rows.values() if "night" in r.time_of_day} == {True}
    assert len({r.motion_style for r in rows.values()}) == len(X.MOTION_STYLES)
    got = {(r.job, r.cam_id): (r.azimuth_deg, round(r.height_m, 6), round(r.distance_m, 6), r.fov_deg) for r in X.expanded_cameras(jobs).collect()}
    assert got == {(1, "cam0"): (0.0, 1.0, 2.5, 60.0), (1, "cam1"): (120.0, 1.6, 3.3, 65.0), (1, "cam2"): (240.0, 2.2, 4.1, 70.0), (3, "cam0"): (0.0, 1.0, 2.5, 60.0)}


def test_output_hashes(spark):
    files = spark.createDataFrame([("e", "out/a.txt", 3, b"abc"), ("e", "out/deep/b.bin", 500, None), ("e", "outer.txt", 1, b"x"), ("f", "out", 2, b"zz")], "k string, path string, size int, content binary")
    declared = spark.createDataFrame([("e", "out"), ("e", "none"), ("e", "out/deep"), ("f", "out")], "k string, output string")
    got = {r.k: (r.entries, r.output_hash) for r in X.output_hashes(declared, files, "k", 100).collect()}
    abc, zz = hashlib.sha256(b"abc").hexdigest(), hashlib.sha256(b"zz").hexdigest()
    text = f'[["none", -1, "missing"], ["out/a.txt", 3, "{abc}"], ["out/deep/b.bin", 500, "size:500"], ["out/deep/b.bin", 500, "size:500"]]'
    assert got == {"e": (4, hashlib.sha256(text.encode()).hexdigest()), "f": (1, hashlib.sha256(f'[["out", 2, "{zz}"]]'.encode()).hexdigest())}


def test_layouts_and_training_counts(spark):
    files = spark.createDataFrame([("e", "raw/v.mp4"), ("e", "qa/frames/1.png"), ("f", "top.txt")], "k string, path string")
    assert {r.k: r.missing for r in X.missing_folders(files, "k", ["raw", "qa", "qa/frames", "export"]).collect()} == {"e": ["export"], "f": ["raw", "qa", "qa/frames", "export"]}
    results = spark.createDataFrame([("human", 5, None), ("animal", 0, "broken"), ("human", 2, None)], "subject string, n_frames int, error string")
    assert tuple(X.training_counts(results).first()) == (3, 2, 1, 7, 1) and tuple(X.training_counts(results.limit(0)).first()) == (0, 0, 0, 0, 0)
