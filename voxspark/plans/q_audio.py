"""Samples and frames: line items stand in for frames of clips, discounts and taxes for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxspark.operators import audio as A
from voxspark.plans.q_speakers import r6, v6
from voxspark.plans.registry import query


def chunks(t):
    """Chunks of samples: a line item each."""
    return t.frames.select("clip", F.col("frame").alias("chunk_index"), F.array(F.element_at("feat", 3) * 8, F.element_at("feat", 4) * 8).alias("audio"))


CH = "(SELECT clip, frame AS chunk_index, [feat[3] * 8, feat[4] * 8] AS audio FROM frames)"
AUDIO = f"(SELECT clip, flatten(list(audio ORDER BY chunk_index)) AS audio FROM {CH} GROUP BY clip)"
SAMPLES = "(SELECT (clip // 150) AS clip, row_number() OVER (PARTITION BY clip // 150 ORDER BY clip, frame) - 1 AS i, feat[3] / 2 AS x FROM frames)"


def audio(t):
    return A.combine_chunks(chunks(t), ["clip"])


@query("S3_combine_chunks", f"SELECT clip, [round(x, 6) for x in audio] AS audio FROM {AUDIO}")
def _(t):
    return audio(t).select("clip", v6("audio").alias("audio"))


@query("S3_chunk_offsets", f"SELECT clip, chunk_index, CAST(len(audio) AS BIGINT) AS n_samples, CAST(coalesce(sum(len(audio)) OVER (PARTITION BY clip ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_sample FROM {CH}")
def _(t):
    return A.chunk_offsets(chunks(t), ["clip"]).select("clip", "chunk_index", F.col("n_samples").cast("long").alias("n_samples"), "first_sample")


@query("J4_slice_audio", f"SELECT clip, [round(x, 6) for x in audio[2:5]] AS audio FROM {AUDIO} WHERE len(audio) >= 5")
def _(t):
    seg = chunks(t).select("clip").distinct().select("clip", (F.lit(1.2) / 16000).alias("start"), (F.lit(4.5) / 16000).alias("end"))
    return A.slice_chunks(seg, chunks(t), ["clip"], strict=True, bucket=3).select("clip", v6("audio").alias("audio"))


@query("A16_clipping_ratio", f"SELECT clip, round(len([x for x in audio if abs(x) >= 0.6]) / CAST(len(audio) AS DOUBLE), 6) AS ratio FROM {AUDIO}")
def _(t):
    return audio(t).select("clip", r6(A.clipping_ratio(F.col("audio"), 0.6)).alias("ratio"))


RMS = f"(SELECT clip, sqrt(list_sum([x * x for x in audio]) / len(audio)) AS rms FROM {AUDIO})"


@query("A17_rms_check", f"SELECT clip, round(rms, 6) AS rms, CASE WHEN rms < 0.3 THEN 'too_quiet' WHEN rms > 0.5 THEN 'too_loud' ELSE 'ok' END AS status FROM {RMS}")
def _(t):
    level = audio(t).select("clip", A.rms(F.col("audio")).alias("rms"))
    return level.select("clip", r6("rms").alias("rms"), A.rms_status(F.col("rms"), 0.3).alias("status"))


SPEECH = f"(SELECT clip, count(*) FILTER (WHERE n = 64 AND level > 0.03) * 64 / CAST(160 AS DOUBLE) AS s, CAST(sum(n) AS BIGINT) / CAST(160 AS DOUBLE) AS total FROM (SELECT clip, i // 64 AS f, count(*) AS n, sqrt(avg(x * x)) AS level FROM {SAMPLES} GROUP BY ALL) GROUP BY clip)"


def samples(t):
    from pyspark.sql import Window

    order = Window.partitionBy(F.floor(F.col("clip") / 150)).orderBy("clip", "frame")
    return t.frames.select((F.floor(F.col("clip") / 150)).alias("group"), (F.row_number().over(order) - 1).alias("i"), (F.element_at("feat", 3) / 2).alias("x")).withColumnRenamed("group", "clip")


@query("A18_speech_content", f"SELECT clip, round(s, 6) AS speech_seconds, round(total, 6) AS total_seconds, round(s / total, 6) AS speech_ratio FROM {SPEECH}")
def _(t):
    return A.speech_content(samples(t), ["clip"], 160, 64, 0.03).withColumns({c: r6(c) for c in ("speech_seconds", "total_seconds", "speech_ratio")})


@query(
    "A19_validate_enrollment_audio",
    f"""SELECT clip, [x for x in [CASE WHEN rms < 0.02 THEN 'too_quiet' WHEN rms > 0.0295 THEN 'too_loud' END, CASE WHEN s < 200 THEN 'too_little_speech' END, CASE WHEN s / total < 0.01 THEN 'low_speech_ratio' END] if x IS NOT NULL] AS errors,
               [x for x in [CASE WHEN c > 0.08 THEN 'clipping' END] if x IS NOT NULL] AS warnings
        FROM {SPEECH} JOIN (SELECT clip, sqrt(avg(x * x)) AS rms, count(*) FILTER (WHERE abs(x) >= 0.05) / CAST(count(*) AS DOUBLE) AS c FROM {SAMPLES} GROUP BY clip) USING (clip)""",
)
def _(t):
    s = samples(t)
    levels = s.groupBy("clip").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.count_if(F.abs("x") >= 0.05) / F.count(F.lit(1))).alias("clipping_ratio"))
    rows = A.speech_content(s, ["clip"], 160, 64, 0.03).join(levels, "clip").withColumn("rms_status", A.rms_status(F.col("rms"), 0.02, 0.0295))
    return A.validate_enrollment_audio(rows, 200.0, 0.01, 0.08).select("clip", "errors", "warnings")


@query("A23_feature_mean_var_norm", "SELECT clip, frame, bin, round((x - avg(x) OVER w) / sqrt(greatest(avg(x * x) OVER w - avg(x) OVER w * avg(x) OVER w, 1e-10)), 6) AS value FROM (SELECT clip, frame, unnest([0, 1, 2, 3]) AS bin, unnest(feat) AS x FROM frames) WINDOW w AS (PARTITION BY clip, bin)")
def _(t):
    return A.feature_mean_var_norm(t.frames, "clip").withColumn("value", F.round("value", 6))


@query("A24_peak_normalize", f"SELECT clip, [round(CASE WHEN list_max([abs(y) for y in audio]) > 0.001 THEN x * 0.95 / list_max([abs(y) for y in audio]) ELSE x END, 6) for x in audio] AS audio FROM {AUDIO}")
def _(t):
    return audio(t).select("clip", v6(A.peak_normalize(F.col("audio"))).alias("audio"))


@query(
    "T4_fixed_chunks",
    """SELECT id, k AS chunk_index, round(CAST(greatest(0, k * 20000 - 3000) AS DOUBLE), 6) AS "start", round(least(duration, k * 20000 + 20000), 6) AS "end", CAST(least(3000, k * 20000) AS DOUBLE) AS overlap
       FROM (SELECT id, duration, unnest(range(0, greatest(CAST(ceil(duration / 20000) AS BIGINT), 1))) AS k FROM recordings)""",
)
def _(t):
    return A.fixed_chunks(t.recordings.select("id", "duration"), 20000.0, 3000.0).select("id", "chunk_index", r6("start").alias("start"), r6("end").alias("end"), "overlap")


@query(
    "T3_split_long_segments",
    """SELECT recording_id, segment_index, p AS piece, round(b - CASE WHEN p > 0 THEN 150 ELSE 0 END, 3) AS "start", round(e, 3) AS "end", p < n - 1 AS forced
       FROM (SELECT *, "start" + p * 1500 AS b, CASE WHEN p = n - 1 THEN "end" ELSE "start" + p * 1500 + 1500 END AS e FROM (SELECT *, unnest(range(0, n)) AS p FROM (SELECT *, CASE WHEN "end" - "start" > 1650 THEN CAST(ceil(("end" - "start") / 1500) AS BIGINT) ELSE 1 END AS n FROM segments)))
       WHERE e - b >= 30""",
)
def _(t):
    out = A.split_long_segments(t.segments, ["recording_id", "segment_index"], 1500.0, 150.0, 30.0)
    return out.select("recording_id", "segment_index", F.col("piece").cast("long").alias("piece"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "forced")


@query(
    "T2_speech_segments",
    """WITH f AS (SELECT clip // 150 AS grp, row_number() OVER (PARTITION BY clip // 150 ORDER BY clip, frame) - 1 AS frame, feat[3] * 10 AS p FROM frames),
       l AS (SELECT *, coalesce(max(CASE WHEN p >= 0.35 THEN frame END) OVER (PARTITION BY grp ORDER BY frame), -1) AS loud FROM f),
       e AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN 1 WHEN frame - loud >= 3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY grp ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM l),
       n AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY grp ORDER BY frame), 0) = 0 THEN 1 ELSE 0 END AS b FROM e),
       s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY grp ORDER BY frame) AS BIGINT) - 1 AS segment_index FROM n)
       SELECT grp AS "group", segment_index, round(CAST(greatest(0, min(frame) * 0.1 - 0.15) AS DOUBLE), 6) AS "start", round(CAST((max(frame) + 1) * 0.1 AS DOUBLE), 6) AS "end" FROM s WHERE st = 1 GROUP BY grp, segment_index HAVING (max(frame) + 1 - min(frame)) * 0.1 >= 0.3""",
)
def _(t):
    p = t.frames.select((F.floor(F.col("clip") / 150)).alias("group"), "clip", "frame", (F.element_at("feat", 3) * 10).alias("p"))
    from pyspark.sql import Window

    rows = p.select("group", (F.row_number().over(Window.partitionBy("group").orderBy("clip", "frame")) - 1).alias("frame"), "p")
    return A.speech_segments(rows, ["group"], 0.1).withColumns({"start": r6("start"), "end": r6("end")})
