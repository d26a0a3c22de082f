"""Streams give what the same functions give over the whole table."""

import os
import random

from pyspark.sql import functions as F

from motionlake.streaming import logs


def events(spark, tmp_path, n=400):
    rnd = random.Random(8)
    rows = [(i, f"2024-01-01 {h:02}:{rnd.randrange(60):02}:{rnd.randrange(60):02}", rnd.randrange(5), rnd.choice("ab"), float(rnd.randrange(100)), rnd.choice(logs.STATES)) for h in range(8) for i in range(h * n // 8, (h + 1) * n // 8)]
    df = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, value double, state string").withColumn("ts", F.to_timestamp("at")).drop("at")
    folder = f"{tmp_path}/events"
    df.repartitionByRange(4, "ts").write.parquet(folder)
    for k, name in enumerate(sorted(n for n in os.listdir(folder) if n.startswith("part"))):  # a stream takes the oldest file first
        os.utime(f"{folder}/{name}", (1_000_000_000 + k, 1_000_000_000 + k))
    return df, logs.event_stream(spark, folder, spark.read.parquet(folder).schema)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_windows(spark, tmp_path):
    table, stream = events(spark, tmp_path)
    for k, work in enumerate((lambda e: logs.tumbling_counts(e, "1 hour", "event_type"), lambda e: logs.sliding_average(e, "2 hours", "1 hour", "event_type"), lambda e: logs.session_windows(e, "10 minutes", "user_id"))):
        same(logs.run_once(work(stream), f"w{k}", f"{tmp_path}/state"), work(table))


def test_repeats_and_states(spark, tmp_path):
    table, stream = events(spark, tmp_path)
    got = logs.run_once(logs.without_repeats(stream, "event_id").select("event_id"), "d", f"{tmp_path}/state", "append")
    assert got.count() == 400
    changes = stream.select(F.col("user_id").alias("job_id"), "ts", "state")
    same(logs.run_once(logs.furthest_state(changes), "j", f"{tmp_path}/state"), logs.furthest_state(table.select(F.col("user_id").alias("job_id"), "ts", "state")))


def test_log_filters(spark):
    log = spark.createDataFrame([(1, "info", "a", "Hello", None, None), (2, "warn", "b", "other", "B7", None), (3, "info", "b", "x", None, "job HELLO")], "id long, level string, agent string, message string, batch_id string, job_id string")
    assert [r.id for r in logs.matching(log, text="hello").orderBy("id").collect()] == [1, 3]
    assert [r.id for r in logs.matching(log, level="warn", text="b7").collect()] == [2]
    assert [r.id for r in logs.since(log, 1).orderBy("id").collect()] == [2, 3] and logs.since(log, None).count() == 3


def test_ids_go_on_without_gaps_and_stay_when_a_batch_is_run_again(spark, tmp_path):
    table, stream = events(spark, tmp_path)
    folder = f"{tmp_path}/numbered"
    logs.append_numbered(stream, folder, ["ts", "event_id"])
    told = lambda: sorted((r.id, r.batch, r.event_id) for r in logs.read_log(spark, folder, stream.schema).collect())
    first = told()
    assert [i for i, _, _ in first] == list(range(400)) and {e for *_, e in first} == set(range(400)) and {b for _, b, _ in first} == {0, 1, 2, 3}
    assert [b for _, b, _ in first] == sorted(b for _, b, _ in first)
    for name in ("commits/3", "commits/.3.crc"):  # the last batch wasn't committed: it runs again
        os.remove(f"{folder}/state/{name}")
    logs.append_numbered(stream, folder, ["ts", "event_id"])
    assert told() == first
    assert logs.numbered(table.limit(0), ["ts"]).count() == 0
