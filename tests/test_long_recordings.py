"""Operators whose rows must stay small on long clips and recordings, against plain models."""

import random

import numpy as np
from pyspark.sql import functions as F

from voxspark.config import Inference
from voxspark.operators import audio as A
from voxspark.operators import inference as I
from voxspark.operators import phrases as P


def test_pooling_across_buckets(spark):
    rng = np.random.default_rng(2)
    clips = {1: rng.normal(size=(1500, 3)), 2: rng.normal(size=(256, 3)), 3: rng.normal(size=(7, 3))}
    frames = spark.createDataFrame([(c, f, [float(x) for x in v]) for c, rows in clips.items() for f, v in enumerate(rows)], "clip long, frame long, feat array<double>")
    spans = [(c, k, a, b) for c in (1, 2, 3, 4) for k, (a, b) in enumerate([(0.0, 2.0), (0.3, 1.9), (1.0, 1.2), (0.2, 0.9), (1.9, 9.0), (1.3, 2.0), (0.0, 0.6)])]
    got = P.pool_frames(spark.createDataFrame(spans, "clip long, k long, start double, end double"), frames, ["clip"], 2.0).collect()
    assert len(got) == len(spans)
    for r in got:
        rate = len(clips.get(r.clip, ())) / 2.0
        low, high = int(np.floor(r.start * rate)), min(int(np.ceil(r.end * rate)), len(clips.get(r.clip, ())))
        assert r.frame_count == max(0, high - low)
        assert r.reason == ("too_short" if r.end - r.start < 0.5 else "no_frames" if high <= low else None)
        assert (r.embedding is None) if r.reason else np.allclose(r.embedding, clips[r.clip][low:high].mean(axis=0))


def test_slices_of_chunks(spark):
    rng = random.Random(4)
    whole, chunks = {}, []
    for rec in range(3):
        whole[rec] = []
        for k in range(12):
            part = [rng.random() for _ in range(rng.choice([0, 1, 5, 40, 90]))]
            chunks.append((rec, k, part))
            whole[rec] += part
    spans = [(rec, k, *sorted((rng.uniform(0, 5), rng.uniform(0, 5)))) for rec in range(4) for k in range(25)] + [(0, 90, 2.0, 1.0), (0, 91, 1.0, 1.0)]
    segments = spark.createDataFrame(spans, "rec long, k long, start double, end double")
    frame = spark.createDataFrame(chunks, "rec long, chunk_index long, audio array<double>")
    for strict in (False, True):
        want = {(r.rec, r.k): r.audio for r in A.slice_audio(segments, A.combine_chunks(frame, ["rec"]), ["rec"], rate=100, strict=strict).collect()}
        got = {(r.rec, r.k): r.audio for r in A.slice_chunks(segments, frame, ["rec"], rate=100, strict=strict, bucket=16).collect()}
        assert got == want and any(want.values())


def test_phrases_of_arrays(spark):
    rng, rows = random.Random(9), []
    for chunk in range(40):
        at = 0.0
        for pos in range(rng.randint(0, 12)):
            start = at + rng.choice([0.0, 0.1, 0.3, -0.1])
            at = start + 0.25
            rows.append((chunk, pos, f"w{pos}", None if rng.random() < 0.1 else start, None if rng.random() < 0.1 else at))
    words = spark.createDataFrame(rows, "chunk long, pos int, text string, start double, end double")
    want = {(r.chunk, r.phrase_id): tuple(map(tuple, r.words)) for r in P.detect_phrases(words, ["chunk"]).collect()}
    arrays = words.groupBy("chunk").agg(F.collect_list(F.struct("pos", "text", "start", "end")).alias("words"))
    got = arrays.select("chunk", F.inline(P.phrases_of(F.col("words")))).collect()
    assert {(r.chunk, r.phrase_id): tuple(map(tuple, r.words)) for r in got} == want
    assert all(r.n_words == len(r.words) and r.start == r.words[0].start and r.end == r.words[-1].end for r in got)


def history(rows, config):
    """Every checkpoint ranked anew."""
    out, labels, shown = [], {}, []
    for n, (label, similarity) in enumerate(rows, 1):
        k, total, first = labels.get(label, (0, 0.0, n))
        labels[label] = k + 1, total + similarity, first
        able = sorted((-(total + (0.0 if x.startswith("Unknown") else 0.1)), first, x) for x, (k, total, first) in labels.items() if k >= config.min_occurrences)
        now = sorted(x for *_, x in able[: config.expected_speakers])
        if n >= config.min_segments and now and not (out and n % 2) and now != shown:
            out.append((len(out) + 1, n, [x for x in now if x not in shown], [x for x in shown if x not in now], now))
            shown = now
    return out


def test_history_of_long_recordings(spark):
    rng, config = random.Random(12), Inference(expected_speakers=3)
    recs = {r: [(rng.choice(["Unknown", *"ABCDEFGH"]), round(rng.uniform(-0.4, 1.0), 3)) for _ in range(n)] for r, n in ((1, 400), (2, 2), (3, 3), (4, 90))}
    recs[5] = [("A" if i % 3 else "B", 0.5) for i in range(100_000)]
    rows = [(r, i, label, s) for r, x in recs.items() for i, (label, s) in enumerate(x)]
    df = spark.createDataFrame(rows, "recording_id long, segment_index long, speaker_label string, similarity double").withColumn("candidates", F.array(F.lit(1)))
    got = {}
    for x in sorted(I.hypothesis_history(df, config).collect(), key=lambda x: x.version):
        got.setdefault(x.recording_id, []).append((x.version, x.total_segments, x.added, x.removed, x.participants))
    assert got == {r: h for r, x in recs.items() if (h := history(x, config))}
    assert len(got[1]) > 5
