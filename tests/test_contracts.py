"""A scenario of a robot, a worker and a box, and what each way of breaking it is told."""

import pytest

from motionlake.operators import contracts as C

ENTITIES = [("robot_01", "humanoid_robot"), ("human_01", "warehouse_worker"), ("box_01", "cardboard_box")]
WORLD = {
    "world_id": "warehouse", "entities": ENTITIES, "registry": ["robot_01", "human_01", "box_01"], "scene_id": "warehouse", "identity_checks": ["box_01_crop_similarity"], "camera_angles": ["overhead_view"],
    "event_types": ["human_slip", "box_slips_from_robot", "human_crosses_path"], "timing": [1.0, 4.0], "deltas": [("human_01", [-0.6, 0.6], [-0.6, 0.6])], "forbidden": ["changing robot_01 appearance"],
}
STEPS = [("robot_01", "walks forward carrying box_01", 0.0, 1.5), ("human_01", "crosses the aisle near robot_01", 1.5, 2.2), ("human_01", "slips and loses balance", 2.2, 3.1), ("robot_01", "stops and stabilizes box_01", 3.1, 5.0)]
GOOD = {
    "scenario_id": "sc_001_human_slip", "title": "Human slips", "referenced": ["robot_01", "human_01", "box_01"], "angle": "overhead_view", "duration": 6.0, "event_type": "human_slip", "description": "slips", "severity": "high",
    "trigger": 2.2, "position_deltas": [("human_01", 0.2, -0.1)], "timeline": STEPS, "response": "stop_and_secure_object", "labels": ["human_slip", "unsafe_proximity", "robot_should_stop"],
}

CASES = {
    "good": ({}, []),
    "missing entity": ({"referenced": ["robot_01", "human_01"]}, ["referenced_entities is missing box_01"]),
    "invented entity": ({"referenced": ["robot_01", "human_01", "box_01", "forklift_01"]}, ["referenced_entities has unknown ids forklift_01"]),
    "camera angle": ({"angle": "front_view"}, ["camera.angle is not allowed"]),
    "event type": ({"event_type": "meteor_strike"}, ["event.type is not allowed"]),
    "trigger": ({"trigger": 0.5}, ["event.trigger_time_seconds is outside the allowed window"]),
    "late trigger": ({"trigger": 5.5}, ["event.trigger_time_seconds is outside the allowed window", "action_timeline must include a robot response after the trigger"]),
    "order": ({"timeline": [STEPS[0], STEPS[3], STEPS[2], STEPS[1]]}, ["action_timeline[2]: not ordered by t_start", "action_timeline[3]: not ordered by t_start"]),
    "actor": ({"timeline": [("ghost_01", *STEPS[0][1:]), *STEPS[1:]]}, ["action_timeline[0]: actor is not a locked entity"]),
    "no response": ({"timeline": [*STEPS[:3], ("human_01", "stands up and steps away from the aisle", 3.1, 5.0)]}, ["action_timeline must include a robot response after the trigger"]),
    "moved too far": ({"position_deltas": [("human_01", 1.2, -0.1)]}, ["position_deltas[0]: dx is out of bounds"]),
    "moved what stays": ({"position_deltas": [("box_01", 0.1, 0.0)]}, ["position_deltas[0]: may not move"]),
    "no step": ({"timeline": []}, ["action_timeline is empty", "action_timeline must include a robot response after the trigger"]),
}


@pytest.fixture(scope="module")
def judged(spark):
    world = spark.createDataFrame([tuple(WORLD.values())], C.CONTRACT)
    rows = [(name, "warehouse", *({**GOOD, "scenario_id": name} | change).values()) for name, (change, _) in CASES.items()]
    found = C.validate(spark.createDataFrame(rows, f"name string, world_id string, {C.SCENARIO}"), world, "world_id", "name")
    return {r.name: r.errors for r in found.select("name", "errors").collect()}


@pytest.mark.parametrize("name", CASES)
def test_scenarios(judged, name):
    assert judged[name] == CASES[name][1]


def test_of_equal_ids_the_first_stays_valid(spark):
    world = spark.createDataFrame([tuple(WORLD.values())], C.CONTRACT)
    rows = [(k, "warehouse", *GOOD.values()) for k in (1, 2)]
    found = {r.place: r.errors for r in C.validate(spark.createDataFrame(rows, f"place int, world_id string, {C.SCENARIO}"), world, "world_id", "place").collect()}
    assert found == {1: [], 2: ["scenario_id is a duplicate"]}


def test_a_registry_that_lacks_an_entity(spark):
    rows = [tuple((WORLD | change).values()) for change in ({}, {"registry": ["robot_01", "human_01"]}, {"entities": ENTITIES[1:], "registry": ["human_01", "box_01"], "scene_id": None, "identity_checks": []})]
    got = [r[0] for r in spark.createDataFrame(rows, C.CONTRACT).select(C.contract_errors()).collect()]
    assert got[0] == [] and got[1] == ["object_registry must hold exactly the locked entities: box_01"]
    assert got[2] == ["scene_registry.scene_id is required", "identity_checks must not be empty", "locked_entities must include a robot"]
