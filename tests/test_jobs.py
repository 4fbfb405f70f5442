"""Jobs under several settings, what a correction changes, saved sessions and exports."""

import json
import random

from pyspark.sql import functions as F

from voxspark.config import Clustering, Inference
from voxspark.operators import clustering as C
from voxspark.plans import jobs as J
from voxspark.sources import recordings as R
from voxspark.sources.snapshots import Store


def voices(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i % 3, i // 3, [rng.gauss(0, 1) + 2 * (k == i % 4) for k in range(5)]) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, segment_index long, embedding array<double>")


def roster(spark):
    return spark.createDataFrame([(k, f"S{k}", [float(j == k) for j in range(5)]) for k in range(3)], "idx int, name string, centroid array<double>")


def test_grid_equals_a_run_for_each_setting(spark):
    jobs = [("a", 0.5, 0.05, 1.1, 2), ("b", 0.7, 0.2, 1.3, 3), ("c", 0.3, 0.0, 1.0, 1)]
    settings = spark.createDataFrame(jobs, "job_id string, similarity double, margin double, boost double, expected_speakers int")
    gates = Inference(min_after_boost=0.2, ambiguity_margin=0.3, confident=0.9, min_for_boost=0.1, unexpected=0.4)
    columns = ["recording_id", "segment_index", "speaker_label", "reason", "display_label", "skip_reason", "was_influenced", "final_name"]
    got = J.process_grid(voices(spark), roster(spark), settings, inference=gates).select("job_id", *columns).collect()
    want = []
    for job, similarity, margin, boost, expected in jobs:
        from dataclasses import replace

        out = J.process_quick(voices(spark), roster(spark), Clustering(similarity=similarity, margin=margin), replace(gates, boost=boost, expected_speakers=expected))
        want += [(job, *r) for r in out.select(columns).collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({tuple(r[2:]) for r in want}) > 5


def test_what_a_correction_changes(spark):
    config, gates = Clustering(similarity=0.6, minimum=0.2, margin=0.0, num_speakers=3), Inference(confident=2.0, ambiguity_margin=2.0, min_for_boost=0.0, min_after_boost=0.1, unexpected=0.5, final_margin=0.0)
    rows = voices(spark).withColumn("is_environmental", F.col("segment_index") % 7 == 6)
    found = C.assign_speakers(rows.where("NOT is_environmental"), ["recording_id"], ["segment_index"], config, candidates=True)
    found = found.unionByName(rows.where("is_environmental"), allowMissingColumns=True)
    label = F.when(F.col("speaker_id") >= 0, F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string"))).when(F.col("speaker_id") == -1, "Unknown")
    found = found.withColumn("speaker_label", label)
    fixes = spark.createDataFrame([(0, 4, 1), (2, 3, 0)], "recording_id long, segment_index long, to_speaker int")
    got = {(r.recording_id, r.segment_index): r for r in J.correction_changes(found, fixes, config, gates).collect()}
    before = {(r.recording_id, r.segment_index): r for r in found.collect()}
    # a sequential model of the centroids
    for rec, at, to in [(0, 4, 1), (1, None, None), (2, 3, 0)]:
        state = C.Centroids()
        for i in range(20):
            r = before[rec, i]
            new = r.speaker_id
            if not r.is_environmental:
                said = C.assign(state, r.embedding, config)[0]
                if at is not None and i == at:
                    if r.speaker_id != to:
                        if r.speaker_id >= 0:
                            state.blend(r.speaker_id, r.embedding, -1)
                        state.blend(to, r.embedding)
                    new = to
                elif at is not None and i > at:
                    new = said
            change = got.get((rec, i))
            if new != r.speaker_id:
                assert change.new_speaker_id == new and change.old_speaker_id == r.speaker_id
            elif change:
                assert change.old_display != change.new_display and change.new_speaker_id == change.old_speaker_id
    assert got and not any(rec == 1 for rec, _ in got) and not any(before[k].is_environmental for k in got)
    assert all(r.new_label == ("Unknown" if r.new_speaker_id == -1 else f"Speaker {r.new_speaker_id + 1}") for r in got.values() if r.new_speaker_id != r.old_speaker_id)


def test_recluster_counts_segment_indices(spark):
    rows = voices(spark, 30).where("recording_id = 0").withColumns({"segment_index": F.col("segment_index") * 10 + 5, "is_environmental": F.lit(False)})
    first = C.assign_speakers(rows, ["recording_id"], ["segment_index"], Clustering(0.6, 0.2, 0.0, 3))
    other = Clustering(similarity=0.95, minimum=0.9, margin=0.0, num_speakers=1)
    out = C.recluster_from(first.withColumn("from_index", F.lit(45)), ["recording_id"], ["segment_index"], other).collect()
    assert all(r.new_speaker_id == r.speaker_id for r in out if r.segment_index < 45) and any(r.new_speaker_id != r.speaker_id for r in out if r.segment_index >= 45)


def test_sessions_in_four_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), R.SESSION_TABLES, buckets=3)
    sessions = spark.createDataFrame([(1, "m"), (2, "m"), (3, "m")], "recording_id long, model_id string")
    segments = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 3.5, "B"), (2, 0, 0.0, 1.0, "A")], "recording_id long, segment_index long, start double, end double, speaker string")
    chunks = spark.createDataFrame([(1, 0, 100), (1, 1, 50), (3, 0, 7)], "recording_id long, chunk_index long, n_samples long")
    for _ in range(2):  # the second time it is a batch tried again
        R.save_sessions(store, 0, sessions, segments, chunks)
        assert [tuple(r) for r in store.read("recordings").collect()] == [(1, 3.5, 2, 2, 2, 720, "1-job-1")]
        assert [(r.recording_id, r.job_id, r.participants) for r in store.read("jobs").collect()] == [(1, "1-job-1", ["A", "B"])]
        assert store.read("segments").count() == 2 and store.read("chunks").count() == 2
    R.save_sessions(store, 1, sessions, segments, spark.createDataFrame([(2, 0, 5)], chunks.schema))
    assert {r.recording_id for r in store.read("recordings").collect()} == {1, 2} and store.versions() == [0, 1]


def test_retention_and_documents(spark):
    parent = spark.createDataFrame([(k, f"2024-01-{k:02d}") for k in range(1, 10)], "id long, at string")
    children = spark.createDataFrame([(k, c) for k in range(1, 10) for c in range(k)], "rec long, c long")
    kept, left, deleted = R.retain_with_children(parent, {"chunks": children}, "at", "id", "rec", 4)
    assert {r.id for r in kept.collect()} == {6, 7, 8, 9} and deleted == 5 and left["chunks"].count() == 30
    jobs = spark.createDataFrame([("j1", 1), ("j2", 2)], "job_id string, recording_id long")
    recordings = spark.createDataFrame([(1, 9.5)], "recording_id long, duration double")
    enrolled = spark.createDataFrame([("j1", "Bo"), ("j1", "Al")], "job_id string, name string")
    one = [{"idx": 1, "name": "Bo", "similarity": 0.9}, {"idx": 0, "name": "Al", "similarity": 0.5}]
    segments = [("j1", 0, "Bo", "Bo", 0.9, one, "Bo", False, False, 0.0, "hi"), ("j1", 1, None, None, None, [], None, None, None, 1.0, "[x]"), ("j1", 2, "Bo", "Al", 0.8, one, "Al", True, True, 2.0, "yo"), ("j1", 3, "Al", "Al", 0.8, one, "Al", False, False, 3.0, "so")]
    schema = f"job_id string, segment_index long, speaker_label string, effective_speaker string, similarity double, candidates {C.CANDIDATES}, display_label string, boosted boolean, was_influenced boolean, start double, text string"
    docs = {r.job_id: json.loads(r.json) for r in R.export_job_document(jobs, recordings, enrolled, spark.createDataFrame(segments, schema)).collect()}
    d = docs["j1"]
    assert d["recording"] == {"recording_id": 1, "duration": 9.5} and [e["name"] for e in d["enrollments"]] == ["Al", "Bo"]
    assert d["stats"] == {"n_segments": 4, "n_boosted": 1, "n_changed": 1, "n_participants": 2}
    assert d["participants"] == [{"name": "Al", "n_segments": 2}, {"name": "Bo", "n_segments": 1}]
    assert [s["segment_index"] for s in d["segments"]] == [0, 1, 2, 3] and d["segments"][2]["boosting"] == {"boosted": True, "was_influenced": True}
    assert d["segments"][0]["candidates"] == [{"rank": 1, "name": "Bo", "similarity": 0.9}, {"rank": 2, "name": "Al", "similarity": 0.5}] and d["segments"][0]["text"] == "hi"
    assert docs["j2"]["stats"]["n_segments"] == 0 and docs["j2"]["segments"] == [] and "recording" not in docs["j2"]
