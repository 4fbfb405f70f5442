"""Markers split over words: the same as a walk over the words, in time that goes with their number."""

import random
import time

from pyspark.sql import functions as F

from voxspark.plans.transcript import join_split_markers

SCHEMA = "id long, words array<struct<text:string,start:double,end:double>>"


def walk(words):
    out, i = [], 0
    marks = [((t or "").strip().startswith("["), (t or "").strip().endswith("]")) for t, _, _ in words]
    while i < len(words):
        close = next((k for k in range(i + 1, len(words)) if marks[k][1]), None)
        stop = close if marks[i][0] and not marks[i][1] and close is not None else i
        out.append(("".join(t or "" for t, _, _ in words[i : stop + 1]), words[i][1], words[stop][2]))
        i = stop + 1
    return out


def test_any_words(spark):
    rng = random.Random(8)
    rows = [(k, [(rng.choice(["a", " b ", " [x", "[", "y] ", "]", "[z]", "", "a[b]c", None]), float(i), i + 0.5) for i in range(rng.randint(0, 14))]) for k in range(400)]
    rows += [(400, None)]
    got = {r.id: r.w for r in spark.createDataFrame(rows, SCHEMA).select("id", join_split_markers(F.col("words")).alias("w")).collect()}
    assert got.pop(400) is None
    assert all([tuple(w) for w in got[k]] == walk(words) for k, words in rows[:-1])


def test_long_turns_take_no_square_of_their_words(spark):
    n = 10_000
    word = lambda i: F.struct(F.when(i % 9 == 2, "[a").when(i % 9 == 4, "b]").otherwise("c").alias("text"), i.cast("double").alias("start"), i.cast("double").alias("end"))
    rows = spark.range(4).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word).alias("words"))
    began = time.time()
    sizes = {r.n for r in rows.select(F.size(join_split_markers(F.col("words"))).alias("n")).collect()}
    assert sizes == {n - 2 * len(range(2, n - 2, 9))} and time.time() - began < 60
