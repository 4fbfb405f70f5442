"""Timers and speech states over several triggers, against the batch operators and by hand."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import collected, in_triggers
from voxspark.operators import audio as A
from voxspark.operators.phrases import detect_phrases
from voxspark.streaming import live as L
from voxspark.streaming.sessions import speech_pieces, timed_sessions
from voxspark.streaming.transcript import keyed_state


@pytest.fixture(autouse=True)
def few_partitions(spark):
    keyed_state(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENTS = "recording_id long, channel_id int, event_id long, wall_time double, kind string, seconds double"


def test_abandoned_sessions_end_by_the_clock(spark, tmp_path):
    one = [(1, 0, 1, 10.0, "enroll", 0.0), (1, 0, 2, 11.0, "start", 0.0), (1, 0, 3, 12.0, "speech", 2.0), (1, 0, 4, 13.0, "pause", 0.0), (1, 0, 5, 14.0, "speech", 3.0), (1, 1, 6, 15.0, "speech", 4.0)]
    still = [(2, 0, 7, 40.0, "start", 0.0), (2, 0, 8, 60.0, "speech", 1.0)]  # not yet `idle` after recording 1's last event
    later = [(2, 0, 9, 90.0, "speech", 5.0)]  # the clock passes 15 + 60
    again = [(1, 0, 10, 95.0, "speech", 9.0), (1, 0, 11, 96.0, "start", 0.0), (1, 0, 12, 97.0, "speech", 6.0), (1, 0, 13, 98.0, "stop", 0.0), (2, 0, 14, 200.0, "speech", 7.0), (2, 0, 15, 201.0, "stop", 0.0)]
    stream = in_triggers(spark, str(tmp_path), EVENTS, one, still, later, again).withColumn("at", F.timestamp_millis((F.col("wall_time") * 1000).cast("long")))
    got = collected(timed_sessions(stream, 60.0), str(tmp_path))
    assert sorted((r.recording_id, r.session, r.channel_id, r.last_event, r.seconds, r.is_final, r.follows, r.n_enrolled) for r in got) == [
        (1, 1, 0, 4, 2.0, False, False, 1), (1, 1, 0, 6, 3.0, True, True, 1), (1, 1, 1, 6, 4.0, True, False, 1), (1, 2, 0, 13, 6.0, True, False, 1),
        # recording 2 was silent from 90 to 200: its session ended, the later speech is outside one
        (2, 1, 0, 9, 6.0, True, False, 0),
    ]


@pytest.mark.parametrize("longest", [None, 2.0])
def test_speech_open_across_triggers(spark, tmp_path, longest):
    rng, rows = random.Random(6), []
    for rec in range(4):
        p, length = 0.2, 300
        for f in range(length):
            p = min(1.0, max(0.0, p + rng.uniform(-0.25, 0.27 if rec != 3 else 0.4)))
            rows.append((rec, rec % 2, f, round(p, 3), f == length - 1))
    schema = "recording_id long, channel_id long, frame long, p double, is_final boolean"
    parts = [[r for r in rows if a <= r[2] < b] for a, b in ((0, 37), (37, 38), (38, 171), (171, 300))]
    got = collected(speech_pieces(in_triggers(spark, str(tmp_path), schema, *parts), 0.1, longest=longest), str(tmp_path))
    spans = A.speech_segments(spark.createDataFrame(rows, schema), ["recording_id", "channel_id"], 0.1)
    keys = ["recording_id", "channel_id", "segment_index"]
    want = A.split_long_segments(spans, keys, longest or 1e9).select(*keys, "piece", "start", "end", "overlap", "forced").collect()
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, got)) == sorted(map(plain, want)) and len(want) > 10
    assert (longest is None) or any(r.forced and r.overlap for r in want)


def test_word_windows_equal_phrases(spark, tmp_path):
    rng, rows = random.Random(8), []
    for rec in range(5):
        at = 0
        for pos in range(60):
            at += rng.choice([0, 40, 150, 199, 201, 900])
            size = rng.randint(1, 400)
            rows.append((rec, pos, f"w{pos}", at / 1000, (at + size) / 1000))
            at += size
    schema = "recording_id long, pos int, text string, start double, end double"
    words = spark.createDataFrame(rows, schema)
    want = {(r.recording_id, round(r.start, 6), round(r.end, 6), r.n_words) for r in detect_phrases(words, ["recording_id"]).collect()}
    stream = in_triggers(spark, str(tmp_path), schema, rows[:31], rows[31:]).withColumn("at", F.timestamp_millis(F.round(F.col("start") * 1000).cast("long")))
    got = L.run_available(L.word_phrases(stream, ["recording_id"]), f"{tmp_path}/out", f"{tmp_path}/state", "complete").collect()
    assert {(r.recording_id, round(r.start, 6), round(r.end, 6), r.n) for r in got} == want
