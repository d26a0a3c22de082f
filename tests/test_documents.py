"""Checks of documents on hand-made rows."""

from motionlake.operators import contracts as C
from motionlake.operators import documents as D


def test_set_errors_in_partitions_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 10)
    locked = spark.createDataFrame([(k, e) for k in range(20) for e in ("a", "b", "a")] + [(90, None), (91, "x")], "id int, e string")
    referenced = spark.createDataFrame([(k, e) for k in range(20) for e in ("b", "c", "a")[: 1 + k % 3]] + [(91, "x"), (92, "y"), (None, "z")], "id int, e string")
    found = D.set_errors(locked, referenced, ["id"], "e")
    plan = found._jdf.queryExecution().executedPlan().toString()
    want = {k: (["a"] if k % 3 < 2 else [], ["c"] if k % 3 else []) for k in range(20)} | {92: ([], ["y"]), None: ([], ["z"])}
    assert {r.id: (r.missing, r.unknown) for r in found.collect()} == want
    pairs = locked.count() + referenced.count()
    assert f", {-(-pairs // 10)}), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 2


def test_scenario_rules_are_not_interpreted_as_one_filter(spark):
    """Rules inside array_compact aren't compiled; a contract's bounds are ordered once a contract, not once a scenario."""
    row = ["w", [("robot", "robot"), ("box", None)], ["robot", "box"], "hall", ["same"], ["top"], ["slip"], None, [("box", [0.5, -0.5], None), ("robot", [1.0], [2.0, None])], None]
    world = spark.createDataFrame([tuple(row)], C.CONTRACT)
    deltas = [("box", 0.5, 0.0), ("box", 0.6, 1e-8), ("robot", 0.0, 1.0), ("robot", 0.1, 3.0), ("ghost", 0.0, 0.0), (None, None, None), ("box", None, None)]
    steps = [("robot", "Move-on", -3.0, 1.0), ("box", None, None, 2.0), ("robot", "pause", -2.0, 1.0), (None, "x", 1.0, 2.0)]
    scenario = ("s", "t", ["robot", "box"], "top", 5.0, "slip", "d", "low", 1.0, deltas, steps, "move", ["slip"])
    found = C.validate(spark.createDataFrame([("w", 1, *scenario)], f"world_id string, n int, {C.SCENARIO}"), world, "world_id", "n")
    assert "knownnotcontainsnull" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().errors == [
        "position_deltas[1]: dx is out of bounds", "position_deltas[1]: dy is out of bounds", "position_deltas[2]: dy is out of bounds", "position_deltas[3]: dx is out of bounds", "position_deltas[4]: not a locked entity", "position_deltas[5]: not a locked entity",
        "action_timeline[0]: t_start/t_end invalid", "action_timeline[0]: not ordered by t_start", "action_timeline[1]: t_start/t_end invalid", "action_timeline[2]: t_start/t_end invalid", "action_timeline[2]: not ordered by t_start", "action_timeline[3]: actor is not a locked entity",
        "action_timeline must include a robot response after the trigger",
    ]
