"""Joints by name, sliding feet, chosen sources, nested documents: cases by hand."""

import json

from pyspark.sql import functions as F

from motionlake.operators import choice, nested, robots


def test_joints_are_found_by_name_then_without_the_vendor(spark):
    dofs = [("r", n, -1.0, 3.0) for n in ("panda_joint1", "joint1", "a_b_c", "b_c", "none", "x_none", "_lead", "tail_")] + [("s", "joint1", 0.0, 1.0)]
    model = [("r", "joint1", 7, -9.0, 9.0, True, 0.5), ("r", "joint1", 3, -2.0, 2.0, True, 0.1), ("r", "b_c", 4, 0.0, 0.0, False, 0.2), ("r", "c", 1, 8.0, 8.0, True, 8.0), ("r", "a_b_c", 9, -5.0, 5.0, True, None), ("r", None, 0, 0.0, 0.0, True, 0.0), ("r", "lead", 5, 1.0, 2.0, True, 1.5)]
    found = robots.joint_limits(spark.createDataFrame(dofs, "robot string, dof string, lo double, hi double"), spark.createDataFrame(model, "robot string, joint string, id int, lo double, hi double, limited boolean, home double"))
    got = {(r.robot, r.dof): (r.joint, r.lo, r.hi, r.home) for r in found.collect()}
    assert got == {
        ("r", "panda_joint1"): ("joint1", -2.0, 2.0, 0.1), ("r", "joint1"): ("joint1", -2.0, 2.0, 0.1), ("r", "a_b_c"): ("a_b_c", -5.0, 5.0, 0.0), ("r", "b_c"): ("b_c", -1.0, 3.0, 0.2),
        ("r", "none"): (None, -1.0, 3.0, 1.0), ("r", "x_none"): (None, -1.0, 3.0, 1.0), ("r", "_lead"): ("lead", 1.0, 2.0, 1.5), ("r", "tail_"): (None, -1.0, 3.0, 1.0), ("s", "joint1"): (None, 0.0, 1.0, 0.5),
    }


def test_feet_slide_only_between_contacts(spark):
    rows = [(1, 0, "l", 0.0, 0.0, True), (1, 1, "l", 0.3, 0.4, True), (1, 2, "l", 9.0, 9.0, False), (1, 3, "l", 0.0, 0.0, True), (1, 1, "r", 5.0, 5.0, True), (1, 2, "r", 5.0, 5.01, True), (1, 3, "r", 5.0, 6.0, None), (2, 0, "l", 1.0, 1.0, True)]
    found = robots.foot_slide(spark.createDataFrame(rows, "clip long, frame long, foot string, x double, y double, contact boolean"), ["clip"], 0.02)
    assert sorted((r.clip, r.check, r.violations, r.max_value, r.skipped) for r in found.collect()) == [(1, "foot_slide", 1, 0.5, False), (2, "foot_slide", 0, 0.0, False)]


def test_first_usable_source(spark):
    ddl = "k long, x double, conf double"
    a = spark.createDataFrame([(1, None, 0.9), (1, 2.0, 0.01), (2, 1.0, 0.5), (2, None, None)], ddl)
    b = spark.createDataFrame([(1, 5.0, 0.5), (2, 6.0, 0.9), (3, None, 0.9), (None, 1.0, 0.9)], ddl)
    mock = spark.createDataFrame([(k, 0.0) for k in (1, 2, 3, 4)], "k long, x double")
    usable = F.col("x").isNotNull() & (F.col("conf") > 0.05)
    rows = sorted(map(repr, ((r.k, r.x, r.place, r.mock) for r in choice.first_usable([a, b], ["k"], usable, mock).collect())))
    assert rows == sorted(map(repr, [(1, 5.0, 1, False), (2, 1.0, 0, False), (2, None, 0, False), (3, 0.0, 2, True), (4, 0.0, 2, True), (None, 1.0, 1, False)]))
    assert {r.k for r in choice.first_usable([a, b], ["k"], usable).collect()} == {1, 2, None}


def test_better_rows_replace_a_part(spark):
    rows = spark.createDataFrame([(1, "object", "cup"), (1, "action", "lift"), (2, "object", "box"), (2, None, "odd")], "k long, track string, name string")
    better = spark.createDataFrame([(1, "object", "tracked cup"), (1, "object", "tracked pan")], "k long, track string, name string")
    assert sorted(r.name for r in choice.replaced(rows, better, ["k"], F.col("track") == "object").collect()) == ["box", "lift", "odd", "tracked cup", "tracked pan"]
    assert choice.replaced(rows, better.limit(0), ["k"], F.col("track") == "object").count() == 4


def test_frames_are_filled_from_the_spine(spark):
    nan = float("nan")
    rows = [("a", 5, 0, 0.0, 0, 1.23456, nan, nan, 0.9), ("a", 5, 0, 0.0, 2, None, 2.0, None, None), ("a", 5, 4, 0.25, 1, -0.00001, 0.5, 7.0, 0.12345), ("a", 9, 0, 0.0, 1, 8.0, 8.0, 8.0, 1.0), ("b", 1, 3, 2.0, 0, 1.0, 1.0, 1.0, 1.0), ("c", None, 0, 0.0, 0, 1.0, 1.0, 1.0, 1.0)]
    found = nested.frame_documents(spark.createDataFrame(rows, "clip string, entity_id int, frame long, t double, joint_idx int, x double, y double, z double, conf double"), ["clip"], 3)
    got = {(r.clip, r.frame): (r.fps, r.n_frames, json.loads(r.doc)) for r in found.collect()}
    empty = [None, None, 0.0, 0.0]
    assert got == {
        ("a", 0): (4.0, 5, {"t": 0.0, "frame": 0, "joints": [[1.2346, None, 0.0, 0.9], empty, [None, 2.0, 0.0, 0.0]]}),
        ("a", 4): (4.0, 5, {"t": 0.25, "frame": 4, "joints": [empty, [0.0, 0.5, 7.0, 0.123], empty]}),
        ("b", 3): (30.0, 4, {"t": 2.0, "frame": 3, "joints": [[1.0, 1.0, 1.0, 1.0], empty, empty]}),
    }


def test_a_contract_is_completed_but_never_overruled(spark):
    entities = spark.createDataFrame([(1, "cup", "mug", "a red mug", None, None), (1, "box", "crate", None, "wood", None), (2, "man", "person", "tall", None, "the tall man")], "w int, id string, type string, appearance string, material string, identity string")
    given = spark.createDataFrame([(1, "box", "own shape", "own", "own", "own", ["one_view"], [])], "w int, entity_id string, shape string, material string, color string, details string, views array<string>, drift array<string>")
    objects = nested.object_anchors(entities, given, "w")
    told = {r.entity_id: r for r in objects.collect()}
    assert (told["cup"].shape, told["cup"].material, told["cup"].color, told["cup"].views) == ("a red mug", nested.NO_MATERIAL, "a red mug", nested.OBJECT_VIEWS)
    assert told["box"].shape == "own shape" and told["man"].shape == "the tall man" and told["man"].details == "tall"
    worlds = spark.createDataFrame([(1, "hall", "tile", "dim", None), (2, "yard", "sand", "sun", "a yard")], "w int, layout string, floor string, lighting string, description string")
    none = spark.createDataFrame([], "w int, scene_id string, layout string, background string, lighting string, spatial_map string, views array<string>, drift array<string>")
    scenes = nested.scene_anchors(worlds, none, "w")
    assert {r.w: (r.scene_id, r.background, r.spatial_map) for r in scenes.collect()} == {1: ("1", "hall; tile floor", "hall"), 2: ("2", "yard; sand floor", "a yard")}
    own = spark.createDataFrame([(2, "mine", "canvas", "t", "d", "s")], "w int, asset_id string, kind string, target string, description string, source string")
    assets = nested.reference_assets(objects, scenes, own, "w").collect()
    assert [r.asset_id for r in assets if r.w == 2] == ["mine"] and sorted(r.asset_id for r in assets if r.w == 1) == sorted(["1_canvas", "box_one_view", *(f"cup_{v}" for v in nested.OBJECT_VIEWS), *(f"1_{v}" for v in nested.SCENE_VIEWS)])
    checks = nested.identity_checks(objects, scenes, spark.createDataFrame([], "w int, check_id string, scope string, target_id string, method string, pass_condition string"), "w").collect()
    assert sorted((r.w, r.check_id) for r in checks) == [(1, "1_layout_similarity"), (1, "box_crop_similarity"), (1, "cup_crop_similarity"), (2, "2_layout_similarity"), (2, "man_crop_similarity")]
