"""Tracks as a stream give what the table gives, however the stream is cut, late rows and restarts included."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionlake.streaming import logs
from motionlake.streaming import trackers as R

DDL = "episode_id long, track_id long, ts string, frame long, x double, y double"
KEYS, GAP = ["episode_id", "track_id"], 600_000


def detections(n=300):
    """Rows in the order in which they come: mostly in time, some up to nine minutes late; tracks pause for longer than the gap."""
    draw = random.Random(4)
    rows = []
    for i in range(n):
        minute = i // 3 - draw.choice([0, 0, 0, 3, 9])
        track = draw.randrange(6)
        if (minute // 25 + track) % 3:
            rows.append((track // 3, track, f"2024-01-01 {max(minute, 0) // 60:02}:{max(minute, 0) % 60:02}:{draw.randrange(60):02}.{draw.randrange(1000):03}", i, draw.choice([None, float(draw.randrange(50))]), draw.random()))
    return rows


def files(spark, rows, cuts, folder):
    bounds = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        spark.createDataFrame(rows[a:b], DDL).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part") and os.stat(f"{folder}/{name}").st_mtime > 1_500_000_000:
                os.utime(f"{folder}/{name}", (1_000_000_000 + k, 1_000_000_000 + k))


def told(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def expected(spark):
    rows = detections()
    end = max(r[2] for r in rows)
    table = spark.createDataFrame(rows, DDL).withColumn("ts", F.to_timestamp("ts"))
    return rows, told(R.track_rows(table, KEYS, 6.0, str(spark.sql(f"SELECT timestamp'{end}' - INTERVAL 10 MINUTES AS t").first().t), GAP))


@pytest.mark.parametrize("cuts", [[], [40, 90, 91, 170]])
def test_stream_equals_table_however_it_is_cut(spark, tmp_path, expected, cuts):
    rows, want = expected
    files(spark, rows, cuts, f"{tmp_path}/in")
    stream = logs.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    got = R.run_to_end(R.track_stream(stream, KEYS, 6.0, "10 minutes", GAP), f"{tmp_path}/out")
    assert told(got) == want and {r.kind for r in got.collect()} == {"seen", "ended"}


def test_restarts_and_late_rows(spark, tmp_path, expected):
    """New files between runs that go on from the checkpoint; a row far behind the watermark is dropped."""
    rows, want = expected
    for k, (a, b) in enumerate(((0, 120), (120, 200), (200, len(rows)))):
        part = [*rows[a:b], (0, 1, "2023-12-31 00:00:00", 999, 1.0, 1.0)][: b - a + (k > 0)]
        files(spark, part, [], f"{tmp_path}/in")
        stream = logs.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        got = R.run_to_end(R.track_stream(stream, KEYS, 6.0, "10 minutes", GAP), f"{tmp_path}/out")
    assert told(got) == want


def test_hand_made_track(spark):
    rows = [(1, 1, f"2024-01-01 00:{m:02}:00", m, float(m * m), 0.0) for m in (0, 1, 3, 20)] + [(1, 2, "2024-01-01 00:00:00", 1, None, 2.0), (1, None, "2024-01-01 00:00:00", 1, 1.0, 2.0)]
    table = spark.createDataFrame(rows, DDL).withColumn("ts", F.to_timestamp("ts"))
    got = [(r.track_id, r.kind, r.frame, r.vx, r.n) for r in R.track_rows(table, KEYS, 2.0, "2024-01-01 00:25:00", GAP).orderBy("track_id", "ts", F.desc("kind")).collect()]
    assert got == [(1, "seen", 0, 0.0, 1), (1, "seen", 1, 2.0, 2), (1, "seen", 3, 16.0, 3), (1, "ended", 3, None, 3), (1, "seen", 20, 0.0, 1), (2, "seen", 1, 0.0, 1), (2, "ended", 1, None, 1)]
    assert R.track_rows(table.limit(0), KEYS, 2.0).count() == 0


class Calls:
    """A handle and its states, which count what is asked of them."""

    def __init__(self):
        self.stored, self.n = [], 0

    def counted(self, *values):
        self.n += 1

    getValueState = getListState = lambda self, *_: self
    registerTimer = counted

    def appendValue(self, value):
        self.stored.append(value)
        self.n += 1

    def appendList(self, values):
        self.stored += values
        self.n += 1


@pytest.mark.parametrize("n", [1, 500])
def test_rows_of_a_batch_are_one_element_of_state(n):
    calls, tracker = Calls(), R.Tracker(["k"], 6.0, GAP)
    tracker.init(calls)
    part = pd.DataFrame({"ms": range(n), "frame": range(n), "x": [None, *([1.0] * (n - 1))], "y": 2.0})
    assert sum(len(out) == 0 for out in tracker.handleInputRows((1,), iter([part]), None)) == 0
    assert len(calls.stored) == 1 and calls.n == 2
    assert calls.stored[0] == (list(range(n)), list(range(n)), [None, *([1.0] * (n - 1))], [2.0] * n)
