"""Decisions, reports and funnels of hand-made episodes."""

from motionlake.operators import episodes as E

DDL = "k string, stage string, status string, metric string"
ROWS = [("a", "ingest", "success", "n=5"), ("a", "geometry", "failed", None), ("a", "hands", "success", "x"), ("b", "hands", "skipped", "x"), ("b", "qa", "failed", "z"), ("c", "retarget", "success", None), ("c", "ingest", "success", "n=1"), ("c", "ingest", "success", "n=1")]


def test_only_gates_with_metrics_count(spark):
    checks = spark.createDataFrame([("a", True, []), ("b", True, None), ("c", False, ["one", "two", "three", "four"]), ("d", True, []), ("e", None, [])], "k string, passed boolean, reasons array<string>")
    got = {r.k: tuple(r)[1:] for r in E.decisions(spark.createDataFrame(ROWS, DDL), checks, "k").collect()}
    assert got == {
        "a": (True, 2, "", None, None), "b": (False, 1, "hands", "qa", ""), "c": (False, 1, "", "qa", "one; two; three"), "d": (True, 0, "", None, None), "e": (False, 0, "", "qa", ""),
    }


def test_funnel_and_its_mock(spark):
    rows = spark.createDataFrame(ROWS, DDL)
    got = [tuple(r) for r in E.job_funnel(rows, "k", ["ingest", "hands", "qa"], [9, 8, 7]).orderBy("place").collect()]
    assert got == [("ingest", 0, 2, 3, False), ("hands", 1, 2, 3, False), ("qa", 2, 0, 3, False)]
    got = [tuple(r) for r in E.job_funnel(rows.limit(0), "k", ["ingest", "hands", "qa"], [9, 8, 7]).orderBy("place").collect()]
    assert got == [("ingest", 0, 9, 9, True), ("hands", 1, 8, 9, True), ("qa", 2, 7, 9, True)]


def test_reports(spark):
    feasibility = spark.createDataFrame([("c", "proceed", 0.876, 0.1, True, "vlm", ["blur", "text"])], "k string, recommendation string, confidence double, violation_ratio double, plausible boolean, judge string, artifacts array<string>")
    physics = spark.createDataFrame([("c", "go2", True), ("x", "go2", False)], "k string, robot string, valid boolean")
    got = {r.k: r.report for r in E.stage_reports(spark.createDataFrame(ROWS, DDL), feasibility, physics, "k", ["go2", "g1"]).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].startswith("# Yield Report — a\n\n| Stage | Status | Key metric |\n|-------|--------|------------|\n| ingest | success | n=5 |\n| feasibility_judge | pending | — |\n| geometry | failed | — |\n")
    assert got["a"].endswith("| package | pending | — |\n\n## Retarget / physics by robot\n\n- **go2**: retarget=—, physics_valid=—\n- **g1**: retarget=—, physics_valid=—\n")
    assert "- recommendation: **proceed**\n- confidence: 0.88\n- physics_violation_frame_ratio: 0.100\n- physically_plausible: True\n- judge_source: vlm\n- ai_artifacts: blur, text\n" in got["c"]
    assert got["c"].endswith("- **go2**: retarget=success, physics_valid=True\n- **g1**: retarget=success, physics_valid=—\n")
