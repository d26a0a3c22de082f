"""Sources and sinks: round trips, missing and broken inputs, contracts."""

import json

import numpy as np
import pytest

from motionlake.schemas import STAGES, TABLES
from motionlake.sources import sinks, tables


def test_guarded_scan(spark, tmp_path):
    found, notes = tables.read_or_empty(spark, f"{tmp_path}/none", "contacts", "contacts")
    assert found.count() == 0 and notes.first().note.startswith("missing") and "hand" in found.columns
    spark.range(3).write.parquet(f"{tmp_path}/t")
    found, notes = tables.read_or_empty(spark, f"{tmp_path}/t", "contacts", "contacts")
    assert found.count() == 3 and notes.count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "tags": ["x"], "more": 5}, indent=2))
    (tmp_path / "b.json").write_text('{"id": ')
    rows = {r.id: r for r in tables.read_json(spark, str(tmp_path), "id long, tags array<string>").collect()}
    assert rows[1].tags == ["x"] and rows[None]._corrupt is not None
    with pytest.raises(Exception, match="(?i)malformed|parse|failed"):
        tables.read_json(spark, str(tmp_path), "id long", strict=True).collect()
    docs = tables.read_variants(spark, str(tmp_path))
    assert docs.where("doc IS NOT NULL").selectExpr("variant_get(doc, '$.more', 'int') AS m").collect()[0].m == 5
    assert docs.where("doc IS NULL").count() == 1
    names = {r.name: r.size for r in tables.list_files(spark, str(tmp_path), "*.json").collect()}
    assert set(names) == {"a.json", "b.json"} and names["b.json"] == 7


def test_arrays_round_trip(spark, tmp_path):
    np.savez(tmp_path / "x.npz", pose=np.arange(6.0).reshape(3, 2), conf=np.ones(3))
    rows = tables.read_arrays(spark, str(tmp_path), "pose").collect()
    assert {tuple(r["index"]): r.value for r in rows} == {(i, j): 2.0 * i + j for i in range(3) for j in range(2)}
    assert tables.read_arrays(spark, str(tmp_path), "none").count() == 0
    long = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "b", 2.0), (1, 2, "b", 3.0), (2, 5, "a", 4.0)], "clip long, frame long, joint string, v double")
    dense = {r.clip: sinks.load_dense(r.content) for r in sinks.dense_arrays(long, "clip", "frame", "joint", ["a", "b"], "v").collect()}
    t, data = dense[1]
    assert t.tolist() == [0, 2] and data[0].tolist() == [1.0, 2.0] and np.isnan(data[1][0]) and data[1][1] == 3.0


def test_contract_on_write(spark, tmp_path):
    good = [(1, 0.0, 0, "left", 1, True, 0.1, 0.9, "captured"), (1, 0.1, 1, "left", 1, False, 0.2, 0.9, "captured")]
    sinks.write_table(spark.createDataFrame(good, TABLES["contacts"]), f"{tmp_path}/c", "contacts", ["episode_id"], ["episode_id"])
    assert tables.read_table(spark, f"{tmp_path}/c", "contacts").count() == 2
    for bad in ((1, 0.1, 1, "left", 1, False, 0.2, 1.5, "captured"), (1, 0.1, 1, "left", 1, False, 0.2, 0.5, "dream"), (1, 0.0, 1, "left", 1, False, 0.2, 0.5, "captured")):
        with pytest.raises(sinks.ContractError):
            sinks.write_table(spark.createDataFrame([good[0], bad], TABLES["contacts"]), f"{tmp_path}/d", "contacts", ["episode_id"])
    with pytest.raises(sinks.ContractError, match="missing column"):
        sinks.write_table(spark.range(2).withColumnRenamed("id", "episode_id"), f"{tmp_path}/d", "contacts", ["episode_id"])


def test_histories_and_boards(spark):
    old = spark.createDataFrame([(k, f"2024-01-{k:02}") for k in range(1, 8)], "id long, at string")
    new = spark.createDataFrame([(7, "2025"), (8, "2024-02-01")], "id long, at string")
    assert sorted(r.id for r in sinks.bounded_history(old, new, "id", "at", 3).collect()) == [6, 7, 8]
    episodes = spark.createDataFrame([(1,), (2,)], "episode_id long")
    manifests = spark.createDataFrame([(1, "qa", "success")], "episode_id long, stage string, status string")
    board = tables.stage_board(episodes, manifests, list(STAGES)).collect()
    assert len(board) == 24 and sum(r.status == "pending" for r in board) == 23
    assert [r.at for r in tables.prefer(new, old, "id").where("id = 7").collect()] == ["2025"]
    assert tables.newest(old.withColumn("g", old.id % 2), ["g"], "at").count() == 2
    assert list(sinks.markdown(new, ["id", "at"]))[0] == "| id | at |"


def test_csv_with_a_header(spark, tmp_path):
    (tmp_path / "scenes.csv").write_text("Start,End\n0.5,2\nbad,3\n4,5.5\n")
    rows = tables.read_csv(spark, f"{tmp_path}/scenes.csv", "start double, stop double").collect()
    assert [tuple(r) for r in rows] == [(0.5, 2.0), (None, 3.0), (4.0, 5.5)]
    sinks.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "frame int, name string"), f"{tmp_path}/out")
    again = tables.read_csv(spark, f"{tmp_path}/out", "frame int, name string").orderBy("frame").collect()
    assert [tuple(r) for r in again] == [(1, "a,b"), (2, None)]


def test_json_documents_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ü", None), (2, None, [3])], "id int, name string, tags array<int>")
    sinks.write_documents(rows, f"{tmp_path}/docs")
    text = sorted(r.value for r in spark.read.text(f"{tmp_path}/docs").collect())
    assert text == ['{"id":1,"name":"ü"}', '{"id":2,"tags":[3]}']
    for _ in range(2):
        sinks.append_log(rows.select("id"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4


def test_report_documents(spark):
    scores = spark.createDataFrame([(1, 0.456, False, "jumps"), (2, 1.0, True, None)], "episode_id long, score double, plausible boolean, reason string")
    violations = spark.createDataFrame([(1, "jump", 0.4, [3], 7), (1, "skate", 0.987, [1, 2], 8)], "episode_id long, type string, severity double, frames array<bigint>, track_id long")
    got = {r.episode_id: json.loads(r.report) for r in sinks.report_documents(scores, violations).collect()}
    assert got[1]["score"] == 0.46 and [(v["type"], v["severity"], v["frames"]) for v in got[1]["violations"]] == [("skate", 0.99, [1, 2]), ("jump", 0.4, [3])]
    assert got[2] == {"score": 1.0, "plausible": True, "violations": []}
    assert list(sinks.markdown(scores, ["episode_id", "reason"])) == ["| episode_id | reason |", "|---|---|", "| 1 | jumps |", "| 2 |  |"]
