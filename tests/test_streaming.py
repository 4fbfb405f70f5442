"""A stream over what is there gives what the batch gives."""

import uuid

import __spark_entry__
from voxspark.streaming import live as L

SF = "/root/testdata/sf0.001"


def test_live_assignment_equals_the_batch_fold(spark):
    q = __spark_entry__.queries()
    live = {r.ord: (r.speaker_id, r.reason) for r in q["T5_live_assignment"](spark, SF).collect()}
    fold = {r.ord: (r.speaker_id, r.reason) for r in q["C1_assign_speakers"](spark, SF).collect()}
    assert live == fold


def in_triggers(spark, folder, schema, *batches):
    """A stream that reads one file a trigger, in the order written."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    frame = spark.createDataFrame([], schema)
    return L.chunk_stream(spark, f"{folder}/in", frame.schema, files_per_trigger=1)


def collected(stream, folder):
    return L.run_available(stream, f"{folder}/out-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}", "append").collect()


def test_chunks_in_wall_clock_order_over_triggers(spark, tmp_path):
    schema = "recording_id long, channel_id string, chunk_id long, wall_time double"
    first = [(1, "b", 2, 2.0), (1, "a", 1, 1.0), (1, "a", 9, None), (1, "c", 3, 2.0), (2, "a", 5, 7.0)]
    second = [(1, "a", 4, 1.5), (1, "b", 6, 3.0), (2, "a", 5, 7.0)]
    got = collected(L.ordered_chunks(in_triggers(spark, str(tmp_path), schema, first, second)), str(tmp_path))
    assert sorted((r.recording_id, r.sequence, r.chunk_id, r.is_late) for r in got) == [
        (1, 0, 1, False), (1, 1, 2, False), (1, 2, 3, False), (1, 3, 9, False), (1, 4, 4, True), (1, 5, 6, False), (2, 0, 5, False), (2, 1, 5, False),
    ]
    assert collected(L.ordered_chunks(in_triggers(spark, str(tmp_path / "none"), schema, [])), str(tmp_path)) == []


def test_sessions_clear_channels_and_keep_the_enrolled(spark, tmp_path):
    schema = "recording_id long, channel_id int, event_id long, wall_time double, kind string, seconds double"
    kinds = [
        (0, "speech", 9.0), (0, "enroll", 0.0), (0, "start", 0.0), (0, "speech", 1.0), (0, "speech", 2.0), (1, "speech", 4.0), (0, "pause", 0.0), (0, "pause", 0.0),
        (0, "speech", 5.0), (0, "stop", 0.0), (1, "speech", 8.0), (0, "start", 0.0), (1, "speech", 3.0), (0, "enroll", 0.0), (1, "pause", 0.0), (1, "speech", 6.0), (0, "start", 0.0), (0, "stop", 0.0),
    ]
    rows = [(1, c, i, float(i), kind, seconds) for i, (c, kind, seconds) in enumerate(kinds)]
    want = [(1, 0, 6, 3.0, False, False, 1), (1, 0, 9, 5.0, True, True, 1), (1, 1, 9, 4.0, True, False, 1), (2, 1, 14, 3.0, False, False, 2)]
    for n, batches in enumerate(([rows], [rows[:5], rows[5:]])):
        folder = str(tmp_path / str(n))
        got = collected(L.session_lifecycle(in_triggers(spark, folder, schema, *batches)), folder)
        assert sorted((r.session, r.channel_id, r.last_event, r.seconds, r.is_final, r.follows, r.n_enrolled) for r in got) == want
