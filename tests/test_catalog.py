"""Folders as tables: broken and missing documents, defaults, precedence."""

import json

from motionlake.sources import catalog as C


def put(root, path, content):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def test_runs(spark, tmp_path):
    put(tmp_path, "r1/manifest.json", json.dumps({"kind": "verify", "decision": "accept", "plausibility_score": 0.9}, indent=2))
    put(tmp_path, "r2/manifest.json", "{broken")
    put(tmp_path, "r3/clips/a b.mp4", "xyz")
    found = {r.run: r for r in C.runs(spark, str(tmp_path), "http://h/assets/").collect()}
    assert (found["r1"].kind, found["r1"].plausibility_score, found["r1"].manifest_error) == ("verify", 0.9, None)
    assert found["r2"].manifest_error == "invalid_json" and found["r2"].kind is None
    assert found["r3"].manifest_url is None and found["r3"].url == "http://h/assets/r3"
    one = C.run_or_listing(spark, str(tmp_path), "r3", "/a").collect()[0]
    assert one.files["clips/a b.mp4"].size_bytes == 3 and one.files["clips/a b.mp4"].url == "/a/r3/clips/a b.mp4"
    assert C.run_or_listing(spark, str(tmp_path), "r1", "/a").collect()[0].files is None


def test_videos(spark):
    raw = spark.createDataFrame([("s1/a.mp4", 2_500_000), ("animal_x/b.mp4", 1), ("s2/c.mp4", 1), ("s2/.hidden.mp4", 1)], "path string, size long")
    samples = spark.createDataFrame([("human_walk.mp4", 1), ("dog.mp4", 1)], "path string, size long")
    sources = spark.createDataFrame([("s1", "animal")], "source_id string, subject string")
    series = spark.createDataFrame([("animal", "a"), ("human", "dog")], "subject string, stem string")
    found = {r.id: (r.subject, r.has_timeseries, r.size_mb) for r in C.videos(raw, samples, sources, series).collect()}
    assert found == {"s1/a.mp4": ("animal", True, 2.5), "animal_x/b.mp4": ("animal", False, 0.0), "s2/c.mp4": ("human", False, 0.0), "cc_samples/human_walk.mp4": ("human", False, 0.0), "cc_samples/dog.mp4": ("animal", False, 0.0)}


def test_sessions(spark, tmp_path):
    put(tmp_path, "a/session.json", {"session_id": "A", "cameras": ["c0", "c1"]})
    put(tmp_path, "a/sync.json", {"method": "audio", "confidence": 0.8, "cameras": [{"cam_id": "c0", "offset_s": 0.5}]})
    put(tmp_path, "a/qa/cross_view_reproj.json", {"mean_reproj_error_px": 1.5, "per_frame": [{"frame": 1, "reproj_error_px": 1.0}, {"frame": 1, "reproj_error_px": 2.0}, {"frame": 0, "reproj_error_px": 4.0}]})
    put(tmp_path, "b/session.json", "no json")
    found = {r.session: r for r in C.sessions(spark, str(tmp_path)).collect()}
    assert found["a"].sync.method == "audio" and found["a"].calibration is None and found["a"].tier == "multiview_gt"
    assert [(f.frame, f.mean_error_px) for f in found["a"].per_frame] == [(0, 4.0), (1, 1.5)]
    assert found["b"].session_id == "b" and found["b"].cameras == [] and found["b"].per_frame is None


def test_jobs(spark, tmp_path):
    put(tmp_path, "j1/spec.json", {"job_id": "j1", "user_prompt": "p", "variants": [{"variant_id": "e00_c0", "prompt": "x" * 500}, {"variant_id": "e00_c1"}]})
    put(tmp_path, "j1/verification/e00_c0.json", {"verdict": "accept", "verdict_reasons": [], "labels": {"skills": ["walk"]}})
    put(tmp_path, "j1/videos/e00_c0.mp4", "v")
    put(tmp_path, "j2/spec.json", "{")
    (job,) = C.jobs(spark, str(tmp_path)).collect()
    assert [(v.variant_id, v.generated, v.verdict) for v in job.variants] == [("e00_c0", True, "accept"), ("e00_c1", False, None)]
    assert len(job.variants[0].prompt) == 400 and job.variants[0].skills == ["walk"]


def test_restored_jobs(spark):
    videos = spark.createDataFrame([("j1", "sc_1.mp4"), ("j1", "sc_1_labeled.mp4"), ("j2", "sc_2_labeled.mp4"), ("j3", "x.mp4")], "job string, name string")
    reports = spark.createDataFrame([("j1", "", "ACCEPT", True, 0.9, None), ("j3", "sc_9", "reject", None, 0.1, "floats")], "job string, video_id string, decision string, plausible boolean, score double, reason string")
    scenarios = spark.createDataFrame([("sc_1", "One"), ("sc_9", "Nine")], "scenario_id string, title string")
    found = {r.job: (r.scenario_id, r.title, r.status, r.review_status, r.error) for r in C.restored_jobs(videos, reports, scenarios).collect()}
    assert found == {"j1": ("sc_1", "One", "completed", "passed", None), "j2": ("sc_2", "sc_2", "completed", "passed", None), "j3": ("sc_9", "Nine", "failed", "rejected", "floats")}


def test_catalogs_and_constants(spark, tmp_path):
    rows = spark.createDataFrame([("a", "human", "youtube"), ("b", "animal", "direct_url"), ("c", "human", "ftp")], "source_id string, subject string, method string")
    assert [r.source_id for r in C.sources_of(rows, "human").collect()] == ["a"]
    assert C.sources_of(rows, None, ["b", "c"]).count() == 1
    results = spark.createDataFrame([("a", "human", "x", 5, None), ("a", "human", None, None, "404")], "source_id string, subject string, path string, size long, error string")
    assert C.import_manifest(results).collect()[0].asDict() == {"source_id": "a", "subject": "human", "n_files": 1, "n_errors": 1, "bytes": 5}
    found, fixed = rows.select("source_id").limit(1), spark.createDataFrame([("a",), ("m",)], "source_id string")
    assert sorted((r.source_id, r.mock) for r in C.with_constants(found, fixed, "source_id").collect()) == [("a", False), ("m", True)]
    assert C.with_constants(found, fixed, "source_id", only_if_empty=True).count() == 1
    assert C.with_constants(found.limit(0), fixed, "source_id", only_if_empty=True).count() == 2
    put(tmp_path, "robots.yaml", "robots:\n  - {name: go2, dof: 12}\n  - {name: g1, dof: 29}\n")
    put(tmp_path, "broken.yaml", "robots: [unclosed")
    put(tmp_path, "other.yaml", "- a list")
    put(tmp_path, "empty.yaml", "robots:")
    put(tmp_path, "long.yaml", "robots:\n" + "".join(f"  - {{name: r{i}, dof: {i}}}\n" for i in range(3_000)) + "\n" * 120_000 + "  - {name: last, dof: many}\n")
    rows = C.yaml_rows(spark, f"{tmp_path}/*.yaml", "dof int, name string", "robots").collect()
    assert [r.dof for r in rows if r.path.endswith("robots.yaml")] == [12, 29]
    assert {r.path.rpartition("/")[2] for r in rows} == {"robots.yaml", "long.yaml"}
    assert len(rows) == 3_003 and [(r.name, r.dof) for r in rows if r.name == "last"] == [("last", None)]


def test_transcripts(spark, tmp_path):
    put(tmp_path, "r/qa/agentic_transcript.json", {"transcript": [{"action": "run_tool", "args": {"name": "pose"}}, {"action": "think"}, {"action": "finalize"}], "llm_stats": [{"provider": "a"}, {"provider": "b"}, {"provider": "a"}]})
    rows = C.transcripts(spark, str(tmp_path))
    assert rows.collect()[0].actions == ["pose", "FIN"] and rows.collect()[0].n_steps == 3
    assert {(r.provider, r.n) for r in C.provider_counts(rows).collect()} == {("a", 2), ("b", 1)}


def test_predictions_have_both_documents(spark):
    segments = spark.createDataFrame([("a", 1), ("b", 2)], "clip string, segments int")
    reports = spark.createDataFrame([("b", "ok"), ("c", "no")], "clip string, report string")
    assert [tuple(r) for r in C.predictions(segments, reports, "clip").collect()] == [("b", 2, "ok")]
