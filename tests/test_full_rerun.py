"""The full re-run against a closed roster: one shuffle of packed words, the same segments as step by step."""

import os
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxspark.config import Clustering, Inference, Overlap
from voxspark.operators import inference as I
from voxspark.operators.overlap import packed, previous_chunk, unpacked
from voxspark.plans import jobs as J
from voxspark.plans.transcript import merge_transcript

SCHEMA = "recording_id long, chunk_index int, overlap double, words array<struct<pos:int,text:string,start:double,end:double>>"
CLUSTERING = Clustering(similarity=0.6, minimum=0.2, margin=0.05, num_speakers=2)
GATES = Inference(confident=0.97, ambiguity_margin=0.5, min_for_boost=0.2, min_after_boost=0.3, unexpected=0.8, final_margin=0.01)
SAID = [" a", " bee", " bee", " sea", " dee", " [BLANK_AUDIO]", " [MUSIC]", " (laughs)", " ", None, " AUDIO]"]


def chunks(spark, n=160, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if i % 9 == 8:  # of one kind only
            texts = [rng.choice([" [MUSIC]", " [BLANK_AUDIO]", " [WIND]"])] * rng.randint(1, 2)
        else:
            texts = rng.choices(SAID, k=rng.randint(0, 7))
        timed = i % 13 != 12
        words = [(p, t, *([p * 0.5 + (p > 3) * 0.4, p * 0.5 + 0.5 + (p > 3) * 0.4] if timed else [None, None])) for p, t in enumerate(texts)]
        rows.append((i % 5, i // 5, rng.choice([0.0, 1.0, 1.5]), words))
    return spark.createDataFrame(rows, SCHEMA)


def roster(spark):
    return spark.createDataFrame([(k, f"S{k}", [float(j == k) + 0.1 for j in range(3)]) for k in range(3)], "idx int, name string, centroid array<double>")


def voices(phrases):
    n = F.pmod(F.xxhash64("recording_id", "chunk_index", "phrase_id"), F.lit(7))
    vector = F.array(*[F.when(n % 3 == k, 1.0).otherwise(n / 5.0) for k in range(3)])
    return phrases.withColumn("embedding", F.when(n != 6, vector))


def step_by_step(spark):
    """The operators one after the other, with joins."""
    keys = ["recording_id", "chunk_index"]
    found = voices(J.phrase_rows(previous_chunk(chunks(spark), ["recording_id"], ["chunk_index"]), Overlap(), 0.2, keys)).cache()
    earlier = Window.partitionBy("recording_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    at = found.groupBy(*keys).agg(F.first("said").alias("s")).withColumn("time_offset", F.coalesce(F.sum("s").over(earlier), F.lit(0.0))).drop("s")
    found = found.join(at, keys)
    bare = found.where("phrase_id IS NULL").select(*keys, "time_offset", F.col("chunk_text").alias("text"), F.col("chunk_end").alias("end"))
    merged = merge_transcript(found.where("phrase_id IS NOT NULL").drop("said", "chunk_text", "chunk_end"), roster(spark), F.col("time_offset"), keys, CLUSTERING, transcripts=bare)
    order = Window.partitionBy("recording_id").orderBy("chunk_index", "start_time", F.desc("kind"), "phrase_id")
    rows = merged.withColumns({"is_environmental": F.col("kind") == "environmental", "segment_index": F.row_number().over(order) - 1}).cache()
    inferred = I.infer_conversation(rows, GATES)
    return rows.join(inferred.select("recording_id", "segment_index", *[c for c in inferred.columns if c not in rows.columns]), ["recording_id", "segment_index"], "left")


def test_closed_roster_gives_the_same_from_one_shuffle(spark, tmp_path):
    got = J.process_full(chunks(spark), voices, roster(spark), str(tmp_path / "full"), CLUSTERING, GATES)
    want = step_by_step(spark)
    assert sorted(got.columns) == sorted(want.columns)
    same = lambda df: sorted(map(str, df.select(sorted(want.columns)).collect()))
    assert same(got) == same(want)
    assert len({r.display_label for r in got.collect()}) > 3 and len({(r.kind, r.reason) for r in got.collect()}) > 3
    # nothing is written but the roster, and rows are dealt once
    assert os.listdir(tmp_path / "full") == ["roster"]
    slim = got.select("recording_id", "segment_index", "text", "display_label")
    plan = slim._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(recording_id", slim._jdf.queryExecution().executedPlan().toString())) == 1 and "words" in plan


def test_packed_words_come_back(spark):
    words = [(0, "a\x00b", 0.1, 0.2), (1, None, None, 0.3), (2, "\x01n", 1e-9, None), (3, "", 0.0, 1.0), (7, "\x01a\x01b é", 1.5, 2.5)]
    rows = spark.createDataFrame([(1, 0, 0.0, words), (1, 1, 0.0, []), (1, 2, 0.0, None), (1, 3, 0.0, [(0, None, None, None)])], SCHEMA)
    out = rows.withColumn("back", unpacked(packed(F.col("words")))).collect()
    assert all(r.back == r.words for r in out)
