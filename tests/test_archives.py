"""Dataset archives: every member read back, indexes, parts of large batches, and attempts that fail."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from motionlake.sources import archives as A

DDL = "batch_id string, sample string, job_id string, decision string, score double, kind string, content binary"
ROWS = [
    ("b1", "s1", "j1", "accept", 0.9, "video", b"film one"),
    ("b1", "s1", "j1", "accept", 0.9, "labels", b"{}"),
    ("b1", "s1", "j2", None, None, "labeled_preview", b""),
    ("b1", "s1", "j2", None, None, "labels", "Überall".encode()),
    ("b1", "s2", "j3", "passed", 0.5, "report", b"never generated"),
    ("b2", "s1", "j1", "reject", 0.1, "video", os.urandom(5_000)),
    ("b2", "s1", "j1", "reject", 0.1, "unheard of", b"x"),
    ("b2", "s1", "j1", "reject", 0.1, "scenario", None),
    (None, None, None, "passed", 1.0, "video", b"nameless"),
]


def test_members_and_index(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DDL).withColumns({"name": F.lit("clash"), "archive": F.lit(1)})
    A.write_archives(df, f"{tmp_path}/out", {"prompt": "a street"})
    rows = A.read_archives(spark, f"{tmp_path}/out").collect()
    got = {(r.batch_id, r.name): bytes(r.content) for r in rows}
    files = {k: v for k, v in got.items() if k[1] != "dataset.json"}
    assert files == {
        ("b1", "samples/s1/video.mp4"): b"film one", ("b1", "samples/s1/labels.json"): b"{}", ("b1", "samples/s1/labeled_preview.mp4"): b"",
        ("b1", "samples/s1/labels_2.json"): "Überall".encode(), ("b2", "samples/s1/video.mp4"): ROWS[5][6], ("unknown", "samples/unknown/video.mp4"): b"nameless",
    }
    index = json.loads(got["b1", "dataset.json"])
    assert index["prompt"] == "a street" and index["counts"] == {"samples": 2, "accepted": 1, "rejected": 1}
    assert index["samples"][1] == {"scenario_id": "s1", "job_id": "j2", "decision": "unknown", "accepted": False, "plausibility_score": None, "files": {"labeled_preview": "samples/s1/labeled_preview.mp4", "labels": "samples/s1/labels_2.json"}}
    for r in rows:  # any reader of ZIP files finds the same
        with zipfile.ZipFile(f"{tmp_path}/out/{r.archive}") as z:
            assert z.testzip() is None and z.read(r.name) == bytes(r.content) and z.getinfo(r.name).CRC == r.crc
    bare = A.read_archives(spark, f"{tmp_path}/out", content=False).collect()
    assert len(bare) == len(rows) and all(r.content is None and r.size == len(got[r.batch_id, r.name]) for r in bare)


def test_large_batches_make_several_archives(spark, tmp_path):
    rows = [("b", f"s{i:03}", f"j{i}", "accept", 1.0, k, bytes([i]) * 1_000) for i in range(100) for k in ("video", "labels")]
    A.write_archives(spark.createDataFrame(rows, DDL), f"{tmp_path}/out", most_bytes=10_000)
    listed = A.listed(f"{tmp_path}/out")
    assert len(listed) >= 20 and sum(a["samples"] for a in listed) == 100 and all(a["bytes"] < 20_000 for a in listed)
    members = A.read_archives(spark, f"{tmp_path}/out").where("name != 'dataset.json'")
    assert members.count() == 200 and members.groupBy("name").count().where("count > 1").count() == 0
    assert members.groupBy(F.split("name", "/")[1].alias("s")).agg(F.count_distinct("archive").alias("n")).where("n > 1").count() == 0


def test_failed_attempts_are_never_read(spark, tmp_path):
    folder = f"{tmp_path}/out"
    good = spark.createDataFrame(ROWS[:2], DDL)
    A.write_archives(good, folder)
    before = A.read_archives(spark, folder).count()
    many = spark.createDataFrame([("b", f"s{i}", f"j{i}", "accept", 1.0, "video", b"x") for i in range(50)], DDL)
    broken = many.withColumn("score", F.when(F.col("sample") == "s7", F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        A.write_archives(broken, folder)
    writer = A.ArchiveWriter({"path": folder}, False)

    def cut_off():
        yield {"batch_id": "b", "sample": "s", "job_id": "j", "decision": "accept", "score": 1.0, "kind": "video", "content": b"half"}
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(cut_off())
    done = writer.write(iter([{"batch_id": "b", "sample": "s", "job_id": "j", "decision": "accept", "score": 1.0, "kind": "video", "content": b"whole"}]))
    assert A.read_archives(spark, folder).count() == before == 3
    writer.abort([done, None])
    assert not os.path.exists(f"{folder}/{done.archives[0]['file']}")
    A.write_archives(good, folder, mode="append")
    assert A.read_archives(spark, folder).count() == 6
    A.write_archives(good, folder, mode="overwrite")
    assert A.read_archives(spark, folder).count() == 3 and len(A.manifests(folder)) == 1


def test_nothing_to_write_or_read(spark, tmp_path):
    assert A.read_archives(spark, f"{tmp_path}/none").count() == 0
    A.write_archives(spark.createDataFrame(ROWS[4:5], DDL), f"{tmp_path}/out")
    assert A.read_archives(spark, f"{tmp_path}/out").count() == 0
