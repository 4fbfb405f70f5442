"""The transcript merger against a sequential model of the reference, and the full re-run of a job."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxspark.config import Clustering
from voxspark.operators import clustering as C
from voxspark.plans import jobs as J
from voxspark.plans.transcript import merge_transcript

PHRASE = "recording_id long, chunk_index int, phrase_id int, words array<struct<text:string,start:double,end:double>>, start double, end double, embedding array<double>"
TEXTS = [" hello", " there", " [BLANK_AUDIO]", " [MUSIC]", " (laughs)"]


def blank(t):
    return bool(re.match(r"\[BLANK", t.strip(), re.I))


def outside(t):
    return t.strip().startswith("[")


def model(phrases, names, roster, config, texts):
    """One recording after the other, chunk by chunk."""
    out, by_chunk = [], {}
    for p in phrases:
        by_chunk.setdefault(p[:2], []).append(p)
    for rec in sorted({k[0] for k in texts}):
        state = C.Centroids()
        for c in roster:
            state.add(c, frozen=True)
        label = lambda i: "Unknown" if i == -1 else names[i] if i < len(names) else f"Speaker {i + 1}"
        for key in sorted(k for k in texts if k[0] == rec):
            if key not in by_chunk:
                if re.sub(r"\[BLANK_AUDIO\]", "", texts[key]).strip():
                    out.append((*key, 0, 0, label(0), re.sub(r"\[BLANK_AUDIO\]", "", texts[key]).strip(), 10.0 * key[1]))
                continue
            last = None
            for _, _, n, words, start, end, x in by_chunk[key]:
                if all(blank(w[0]) for w in words):
                    continue
                if all(outside(w[0]) for w in words):
                    if end != start:
                        out.append((*key, n, None, None, "".join(w[0] for w in words).strip(), 10.0 * key[1] + start))
                    continue
                last = C.assign(state, x, config) if x is not None else last
                said = [w[0] for w in words if not blank(w[0])]
                if said and end != start and last is not None:
                    out.append((*key, n, last[0], label(last[0]), "".join(said).strip(), 10.0 * key[1] + start))
    return out


@pytest.mark.parametrize("enrolled", [0, 1, 3])
def test_merge_transcript_against_a_sequential_model(spark, enrolled):
    rng = random.Random(11)
    rows, texts = [], {}
    for rec in range(4):
        for chunk in range(6):
            texts[rec, chunk] = rng.choice([" all of it [BLANK_AUDIO]", "[BLANK_AUDIO]"])
            for n in range(rng.randint(0, 5)):
                words = [(rng.choice(TEXTS), n + 0.1 * i, n + 0.1 * i + 0.1) for i in range(rng.randint(1, 4))]
                x = [rng.gauss(0, 1) for _ in range(3)] if rng.random() < 0.7 else None
                rows.append((rec, chunk, n, words, float(n), float(n) + rng.choice([0.0, 0.4, 0.4, 0.4]), x))
    names, vectors = ["Ann", "Bob", "Cid"][:enrolled], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]][:enrolled]
    config = Clustering(0.7, 0.4, 0.1, 3)
    roster = spark.createDataFrame(list(zip(range(enrolled), names, vectors, strict=True)), "idx int, name string, centroid array<double>")
    said = spark.createDataFrame([(*k, t, 4.0) for k, t in texts.items()], "recording_id long, chunk_index int, text string, end double")
    out = merge_transcript(spark.createDataFrame(rows, PHRASE), roster, 10.0 * F.col("chunk_index"), ["recording_id", "chunk_index"], config, transcripts=said)
    got = [(r.recording_id, r.chunk_index, r.phrase_id, r.speaker_id, r.speaker_label, r.text, r.start_time) for r in out.collect()]
    assert sorted(got, key=str) == sorted(model(rows, names, vectors, config, texts), key=str)


def test_process_full_returns_every_segment(spark, tmp_path):
    def said(text, start=0.0, step=0.5):
        return [(i, f" {w}", start + step * i, start + step * (i + 1)) for i, w in enumerate(text.split())]

    chunks = [
        (1, 0, 0.0, said("I am going to the store")),  # to 3.0
        (1, 1, 1.5, said("to the store and home")),  # three words again
        (1, 2, 0.0, said("home [BLANK_AUDIO] now")),  # first word again
        (1, 3, 0.0, said("[MUSIC]")),
        (1, 4, 0.0, said("[BLANK_AUDIO]")),
        (1, 5, 0.0, [(0, " untimed", None, None)]),
        (1, 6, 0.0, said("so long")),
        (1, 7, 0.0, said("then")),  # no voice: inherited
    ]
    schema = "recording_id long, chunk_index int, overlap double, words array<struct<pos:int,text:string,start:double,end:double>>"
    vector = F.when(F.col("chunk_index") < 3, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("chunk_index") == 6, F.array(F.lit(0.0), F.lit(1.0)))
    roster = spark.createDataFrame([(0, "Ann", [1.0, 0.0])], "idx int, name string, centroid array<double>")
    rows = J.process_full(spark.createDataFrame(chunks, schema), lambda p: p.withColumn("embedding", vector), roster, str(tmp_path / "full")).orderBy("segment_index").collect()
    # speakers: Ann is enrolled, the second is found
    assert [(r.chunk_index, r.text, r.speaker_id, r.speaker_label, r.start_time, r.end_time) for r in rows] == [
        (0, "I am going to the store", 0, "Ann", 0.0, 3.0),
        (1, "and home", 0, "Ann", 3.0, 4.0),
        (2, "now", 0, "Ann", 4.5, 5.5),
        (3, "[MUSIC]", None, None, 5.5, 6.0),
        (5, "untimed", 0, "Ann", 6.5, 6.5),
        (6, "so long", 1, "Speaker 2", 6.5, 7.5),
    ]
    assert [r.display_label for r in rows] == ["Ann", "Ann", "Ann", None, None, "Speaker 2"]
    assert rows[0].participants[0].name == "Ann"
