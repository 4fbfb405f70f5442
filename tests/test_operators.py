"""Literal examples and sequential models of the reference semantics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.config import Clustering, Overlap, UnknownClustering
from voxspark.functions import text as X
from voxspark.functions import vectors as V
from voxspark.operators import beside as B
from voxspark.operators import clustering as C
from voxspark.operators import metrics as M
from voxspark.operators import overlap as O
from voxspark.operators import phrases as P
from voxspark.plans.transcript import join_split_markers

WORDS = "recording_id long, pos int, text string, start double, end double"


def words(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], WORDS)


def test_pauses_split_phrases(spark):
    said = [("The", 0.0, 0.15), ("quick", 0.16, 0.4), ("brown", 0.42, 0.7), ("fox", 0.72, 1.0), ("jumps", 1.5, 1.8), ("over", 1.82, 2.1), ("the", 2.12, 2.3), ("lazy", 2.32, 2.6), ("dog", 2.62, 2.9)]
    out = P.detect_phrases(words(spark, said), ["recording_id"]).orderBy("phrase_id").collect()
    assert [(r.start, r.end, r.n_words) for r in out] == [(0.0, 1.0, 4), (1.5, 2.9, 5)]


def test_words_without_times_are_dropped(spark):
    out = P.detect_phrases(words(spark, [("a", None, 1.0), ("b", 1.0, 1.1), ("c", 1.15, None)]), ["recording_id"]).collect()
    assert [r.n_words for r in out] == [1]


def chunk_pair(spark, prev, curr, overlap):
    def timed(text, start):
        return [(w, start + 0.5 * i, start + 0.5 * (i + 1)) for i, w in enumerate(text.split())]

    schema = "recording_id long, overlap double, prev_words array<struct<text:string,start:double,end:double>>, words array<struct<text:string,start:double,end:double>>"
    return spark.createDataFrame([(1, overlap, timed(prev, 0.0), timed(curr, 0.0))], schema)


@pytest.mark.parametrize(
    ("prev", "curr", "method", "index"),
    [("I am going to the store", "to the store and then home", "text_match", 3), ("alpha beta gamma", "one two three four", "no_text_match", 0)],
)
def test_alignment(spark, prev, curr, method, index):
    r = O.align_overlap(chunk_pair(spark, prev, curr, 1.5), Overlap()).first()
    assert (r.method, r.merge_index) == (method, index)


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), (None, [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    for r in df.select("want", V.cosine_similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_sounds(spark):
    want = {"[BLANK_AUDIO]": "blank", "": "blank", "(laughs)": "human_voice", "[MUSIC]": "environmental", "hello": "speech", "[open": "speech"}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", X.classify_sound(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == want


def test_white_space_of_any_kind_at_the_ends(spark):
    df = spark.createDataFrame([("[MUSIC]\n",), ("\t[blank_audio]\r\n",), ("\u00a0 \u3000",), ("\ufeffHello\u2028",), (None,)], "text string")
    t = F.col("text")
    got = [tuple(r) for r in df.select(X.is_bracketed_marker(t), X.is_blank_audio(t), X.classify_sound(t), X.trim(t)).collect()]
    assert got == [
        (True, False, "environmental", "[MUSIC]"),
        (True, True, "blank", "[blank_audio]"),
        (False, False, "blank", ""),
        (False, False, "speech", "Hello"),
        (False, False, "blank", None),
    ]


def test_split_markers(spark):
    def model(ws):
        out, i = [], 0
        while i < len(ws):
            if ws[i].strip().startswith("[") and not ws[i].strip().endswith("]"):
                close = next((j for j in range(i + 1, len(ws)) if ws[j].strip().endswith("]")), None)
                if close is not None:
                    out.append("".join(ws[i : close + 1]))
                    i = close + 1
                    continue
            out.append(ws[i])
            i += 1
        return out

    rng = random.Random(2)
    cases = [[rng.choice(["a", "[b", "c]", "[d]", "["]) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, [(w, 0.0, 1.0) for w in c]) for i, c in enumerate(cases)], "i int, words array<struct<text:string,start:double,end:double>>")
    for r in df.select("i", F.transform(join_split_markers(F.col("words")), lambda w: w["text"]).alias("w")).collect():
        assert r.w == model(cases[r.i]), cases[r.i]


def random_segments(rng, n):
    at, out = 0.0, []
    for i in range(n):
        at += rng.random() * 0.6
        out.append((1, i, round(at, 3), round(at + rng.random(), 3), rng.choice("ab"), rng.random()))
    return out


def test_merge_same_speaker_against_a_sequential_model(spark):
    rng = random.Random(5)
    rows = [(k, *r[1:]) for k in range(40) for r in random_segments(rng, rng.randint(1, 9))]
    want = []
    for k in range(40):
        kept = []
        for _, _, s, e, who, c in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if kept and kept[-1][2] == who and s - kept[-1][1] <= 0.2:
                kept[-1] = [kept[-1][0], max(kept[-1][1], e), who, (kept[-1][3] + c) / 2]
            else:
                kept.append([s, e, who, c])
        want += [(k, *x) for x in kept]
    df = spark.createDataFrame(rows, "k int, seg_id int, start double, end double, speaker string, confidence double")
    got = sorted((r.k, r.start, r.end, r.speaker, r.confidence) for r in P.merge_same_speaker(df, ["k"], 0.2).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g == pytest.approx(w) if isinstance(g, float) else (g[:2] == w[:2] and g[3] == w[3] and g[4] == pytest.approx(w[4]))


def test_online_clusterer(spark):
    def voice(seed):
        v = np.array([np.sin(seed * (i + 1)) + np.cos(0.5 * seed * i) for i in range(64)])
        return (v / np.linalg.norm(v)).tolist()

    rows = [(1, 0, voice(1)), (1, 1, voice(1)), (1, 2, voice(5)), (1, 3, voice(9)), (1, 4, None)]
    df = spark.createDataFrame(rows, "recording_id long, ord int, embedding array<double>")
    got = {r.ord: (r.speaker_id, r.reason) for r in C.assign_speakers(df, ["recording_id"], ["ord"], Clustering()).collect()}
    assert got[0] == (0, "new_speaker") and got[1] == (0, "confident_match") and got[2] == (1, "new_speaker")
    assert got[3][0] == -1 and got[4] == (0, "no_embedding")
    unknown = spark.createDataFrame([(1, i, -1, voice(s)) for i, s in enumerate((1, 1, 5, 9))], "recording_id long, segment_index int, speaker_id int, embedding array<double>")
    ids = [r.unknown_id for r in C.cluster_unknowns(unknown, ["recording_id"], ["segment_index"], UnknownClustering()).orderBy("segment_index").collect()]
    assert ids == [-100, -100, -101, -102]


def fold(rows, config, start=None, at=None, to=None):
    """The clusterer in plain loops: centroids as (vector, count); speakers from `start` on anew, or a correction at `at`."""
    unit = lambda v: v / np.linalg.norm(v)
    centroids, out = [], []

    def blend(i, v, sign):
        c, n = centroids[i]
        if sign > 0 or n > 1:
            centroids[i] = (unit(c * n + sign * v), n + sign)

    def assign(v):
        s = [float(c @ v) for c, _ in centroids]
        order = sorted(range(len(s)), key=lambda i: -s[i])
        if s and s[order[0]] >= config.similarity:
            if len(s) > 1 and s[order[0]] - s[order[1]] < config.margin:
                return -1
            blend(order[0], v, 1)
            return order[0]
        if len(s) < config.num_speakers:
            centroids.append((v, 1))
            return len(s)
        return -1

    for i, (old, env, v) in enumerate(rows):
        if v is None or (start is not None and env):
            out.append(old)
            continue
        v = unit(np.array(v))
        new = assign(v)
        if i == at:
            if 0 <= old < len(centroids) and old != to:
                blend(old, v, -1)
            if to < len(centroids) and old != to:
                blend(to, v, 1)
            out.append(to)
        else:
            out.append(old if i < (at if start is None else start) else new)
    return out


def test_recluster_and_reassign_against_a_sequential_model(spark):
    rng = np.random.default_rng(3)
    voices, config, data, rows = rng.normal(size=(4, 8)), Clustering(0.6, 0.4, 0.1, 3), {}, []
    for k in range(12):
        said = [None if rng.random() < 0.1 else (voices[rng.integers(4)] + 0.5 * rng.normal(size=8)).tolist() for _ in range(15)]
        olds = fold([(0, False, v) for v in said], config, at=-1)
        data[k] = [(o, bool(rng.random() < 0.2), v) for o, v in zip(olds, said, strict=True)]
        rows += [(k, i, o, e, v) for i, (o, e, v) in enumerate(data[k])]
    df = spark.createDataFrame(rows, "recording_id int, segment_index int, speaker_id int, is_environmental boolean, embedding array<double>")
    other = Clustering(0.4, 0.2, 0.0, 4)
    got = C.recluster_from(df.withColumn("from_index", F.lit(5)), ["recording_id"], ["segment_index"], other).orderBy("recording_id", "segment_index").collect()
    assert [r.new_speaker_id for r in got] == [s for k in data for s in fold(data[k], other, start=5)]
    fixes = spark.createDataFrame([(k, 4, 1) for k in data if k != 11], "recording_id int, segment_index int, to_speaker int")
    got = C.reassign_segment(df.drop("is_environmental"), fixes, ["recording_id"], ["segment_index"], config).orderBy("recording_id", "segment_index").collect()
    want = [s for k in data for s in ([o for o, _, _ in data[k]] if k == 11 else fold(data[k], config, at=4, to=1))]
    assert [r.new_speaker_id for r in got] == want


def test_pca_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * np.array([9.0, 4.0, 1.0, 0.5, 0.1]) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "i int, embedding array<double>")
    got = sorted((r.i, r.x, r.y) for r in M.pca_2d(df, "i").collect())
    centred = x - x.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    want = centred @ axes[:, [-1, -2]]
    assert [r[0] for r in got] == list(range(300))
    assert np.allclose(np.abs([r[1:] for r in got]), np.abs(want), atol=1e-6)


@pytest.mark.parametrize("bound", [10, 0])
def test_one_row_beside_all(spark, monkeypatch, bound):
    monkeypatch.setattr(B, "BROADCAST_ITEMS", bound)
    listed = spark.createDataFrame([(i,) for i in range(3)], "v int")
    one = listed.agg(F.sort_array(F.collect_list("v")).alias("all"))
    got = B.beside(spark.range(50).repartition(7), listed, one).collect()
    assert sorted((r.id, tuple(r.all)) for r in got) == [(i, (0, 1, 2)) for i in range(50)]
