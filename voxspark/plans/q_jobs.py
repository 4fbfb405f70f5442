"""Folds, jobs and streams over the bound tables."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxspark.config import Clustering, Inference, UnknownClustering
from voxspark.functions import text as X
from voxspark.functions.vectors import doubles
from voxspark.operators import clustering as C
from voxspark.operators.phrases import detect_phrases
from voxspark.plans import jobs as J
from voxspark.plans.folders import folder
from voxspark.plans.q_inference import BOOST, GATES, segments
from voxspark.plans.q_phrases import CHUNK
from voxspark.plans.q_speakers import SCALED, r6, roster
from voxspark.plans.registry import query
from voxspark.plans.transcript import merge_transcript
from voxspark.sources.bindings import SQL, sample_scorer
from voxspark.sources.snapshots import Store
from voxspark.streaming import live as L
from voxspark.streaming import transcript as TR
from voxspark.streaming.sessions import speech_pieces, timed_sessions

ONLINE = Clustering(similarity=0.2, minimum=0.1, margin=0.02, num_speakers=6)


def voices(t):
    return t.voices.select("recording_id", "ord", "embedding")


UNIT = "list_transform({0}, lambda y: y / sqrt(list_dot_product({0}, {0})))"
#: A unit vector mixed into a centroid of `n` others, then its length made 1.
MIX = "list_transform(list_zip({c}, {u}), lambda p: (p[1] * {n} + p[2]) / ({n} + 1))"


def fold_sql(rows: str, keep: str, new: str, joins: str) -> str:
    """A recording's vectors clustered one after the other, as a recursive query whose state is the list of centroids.

    rows: recording_id, n (from 1), u (unit vector) and `keep`; new and joins: conditions on best (similarity), margin
    and k (clusters so far) for a new cluster and for joining the best one.
    """
    mixed = MIX.format(c="cents[pick]", u="u", n="counts[pick]")
    return f"""v AS ({rows}),
        fold AS (SELECT recording_id, n, {keep}, [u] AS cents, [CAST(1 AS BIGINT)] AS counts, CAST(1 AS BIGINT) AS pick, 1 AS k, true AS is_new, true AS is_joined, CAST(1 AS DOUBLE) AS best, CAST(1 AS DOUBLE) AS margin FROM v WHERE n = 1
          UNION ALL
          SELECT recording_id, n, {keep}, CASE WHEN is_new THEN list_append(cents, u) WHEN is_joined THEN list_transform(range(1, len(cents) + 1), lambda i: CASE WHEN i = pick THEN mixed ELSE cents[i] END) ELSE cents END,
                 CASE WHEN is_new THEN list_append(counts, 1) WHEN is_joined THEN list_transform(range(1, len(cents) + 1), lambda i: counts[i] + CASE WHEN i = pick THEN 1 ELSE 0 END) ELSE counts END,
                 CASE WHEN is_new THEN len(cents) + 1 ELSE pick END, k + CASE WHEN is_new THEN 1 ELSE 0 END, is_new, is_joined, best, margin
          FROM (SELECT *, {new} AS is_new, {joins} AS is_joined, {UNIT.format("raw")} AS mixed FROM (
            SELECT *, {mixed} AS raw FROM (SELECT *, list_position(s, list_max(s)) AS pick, list_max(s) AS best, CASE WHEN k > 1 THEN list_sort(s)[-1] - list_sort(s)[-2] ELSE list_max(s) + 1 END AS margin FROM (
              SELECT v.*, fold.cents, fold.counts, fold.k, list_transform(fold.cents, lambda c: list_dot_product(c, v.u) / sqrt(list_dot_product(c, c) * list_dot_product(v.u, v.u))) AS s
              FROM fold JOIN v ON v.recording_id = fold.recording_id AND v.n = fold.n + 1)))))"""


ORDERED = f"SELECT recording_id, ord, row_number() OVER (PARTITION BY recording_id ORDER BY ord) AS n, {UNIT.format('embedding')} AS u FROM voices"


@query(
    "C1_assign_speakers",
    f"""WITH RECURSIVE {fold_sql(ORDERED, "ord", "best < 0.2 AND k < 6", "best >= 0.2 AND (k = 1 OR margin >= 0.02)")}
        SELECT recording_id, ord, CAST(CASE WHEN is_new OR is_joined THEN pick - 1 ELSE -1 END AS INTEGER) AS speaker_id, CASE WHEN is_new THEN 1 ELSE round(best, 6) END AS similarity,
               CASE WHEN is_new THEN 'new_speaker' WHEN is_joined THEN 'confident_match' WHEN best >= 0.2 THEN 'ambiguous_match' WHEN best < 0.1 THEN 'below_minimum_threshold' ELSE 'no_confident_match' END AS reason FROM fold""",
)
def _(t):
    return C.assign_speakers(voices(t), ["recording_id"], ["ord"], ONLINE).select("recording_id", "ord", "speaker_id", r6("similarity").alias("similarity"), "reason")


UNKNOWNS = f"""SELECT a.recording_id, a.ord, row_number() OVER (PARTITION BY a.recording_id ORDER BY a.ord) AS n, {UNIT.format('embedding')} AS u FROM assigned a JOIN voices USING (ord) WHERE speaker_id = -1"""


@query(
    "C3_cluster_unknowns",
    f"""WITH RECURSIVE {fold_sql(UNKNOWNS, "ord", "best < 0.2 AND k < 4", "best >= 0.2 OR k = 4")}
        SELECT a.recording_id, row_number() OVER (PARTITION BY a.recording_id ORDER BY a.ord) - 1 AS segment_index, a.speaker_id, CAST(-100 - (pick - 1) AS INTEGER) AS unknown_id FROM assigned a LEFT JOIN fold USING (ord)""",
)
def _(t):
    s = segments(t).select("recording_id", "segment_index", F.col("speaker_id").cast("int").alias("speaker_id"), "embedding")
    return C.cluster_unknowns(s, ["recording_id"], ["segment_index"], UnknownClustering(similarity=0.2)).select("recording_id", "segment_index", "speaker_id", "unknown_id")


def online(t):
    """Speakers found in order; every eleventh row is a sound of the surroundings and has none."""
    env = (F.col("ord") % 11 == 0).alias("is_environmental")
    rows = t.voices.select("recording_id", "ord", "embedding", env)
    out = C.assign_speakers(rows.where("NOT is_environmental"), ["recording_id"], ["ord"], ONLINE, candidates=True)
    out = out.unionByName(rows.where("is_environmental"), allowMissingColumns=True)
    index = (F.row_number().over(Window.partitionBy("recording_id").orderBy("ord")) - 1).alias("segment_index")
    label = F.when(F.col("speaker_id").isNotNull(), X.speaker_label(F.col("speaker_id"), F.lit(None).cast("string"))).alias("speaker_label")
    return out.select("recording_id", index, "embedding", "speaker_id", "is_environmental", label, "similarity", "candidates")


@query("C4_recluster_from")
def _(t):
    rows = online(t).withColumn("from_index", F.lit(5))
    return C.recluster_from(rows, ["recording_id"], ["segment_index"], Clustering(0.15, 0.1, 0.0, 6)).select("recording_id", "segment_index", "speaker_id", "new_speaker_id")


@query("C5_reassign_segment")
def _(t):
    fixes = online(t).groupBy("recording_id").agg(F.lit(4).alias("segment_index"), F.lit(1).alias("to_speaker"))
    return C.reassign_segment(online(t), fixes, ["recording_id"], ["segment_index"], ONLINE).select("recording_id", "segment_index", "speaker_id", "new_speaker_id")


@query("C5_correction_changes")
def _(t):
    rows = online(t)
    fixes = rows.where("NOT is_environmental AND segment_index >= 4").groupBy("recording_id").agg(F.min("segment_index").alias("segment_index"), F.lit(1).alias("to_speaker"))
    return J.correction_changes(rows, fixes, ONLINE, GATES)


@query("E11_inherit_speaker", """WITH a AS (SELECT ord, recording_id, CASE WHEN ord % 5 < 2 THEN NULL ELSE speaker_id END AS s FROM assigned)
    SELECT ord, recording_id, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS speaker_id FROM a""")
def _(t):
    own = F.when(F.col("ord") % 5 >= 2, F.col("speaker_id"))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy("recording_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return segments(t).select("ord", "recording_id", F.coalesce(last, F.lit(0)).cast("int").alias("speaker_id"))


@query("C11_process_quick", f"WITH {BOOST} SELECT recording_id, segment_index, display_label FROM att")
def _(t):
    order = Window.partitionBy("recording_id").orderBy("ord")
    rows = voices(t).withColumn("segment_index", F.row_number().over(order) - 1)
    return J.process_quick(rows, roster(t), SCALED, GATES).select("recording_id", "segment_index", "display_label")


#: Two speakers of `sample_scorer`, and how sure a match must be.
HEARD = [(0, "Low", [0.1, 0.01, 0.3]), (1, "High", [0.6, 0.1, 0.3])]
SURE = Clustering(similarity=0.97, minimum=0.5, margin=0.0)


@query(
    "C11_process_audio",
    """WITH a AS (SELECT clip, flatten(list([feat[3] * 8, feat[4] * 8] ORDER BY frame)) AS x FROM frames GROUP BY clip),
       s AS (SELECT clip, k, k % 4 = 3 AS env, x[2 * k + 1:2 * k + 3] AS x FROM a, (SELECT unnest(range(0, 5)) AS k)),
       v AS (SELECT *, [list_avg(x), list_avg(list_transform(x, lambda y: (y - list_avg(x)) * (y - list_avg(x)))), len(x) / CAST(10 AS DOUBLE)] AS v FROM s WHERE NOT env AND len(x) = 3),
       c AS (SELECT *, list_cosine_similarity(v, [CAST(0.1 AS DOUBLE), 0.01, 0.3]) AS low, list_cosine_similarity(v, [CAST(0.6 AS DOUBLE), 0.1, 0.3]) AS high FROM v)
       SELECT s.clip AS recording_id, s.k AS segment_index, CASE WHEN c.clip IS NULL THEN 'old' WHEN greatest(low, high) < 0.97 THEN 'Unknown' WHEN low >= high THEN 'Low' ELSE 'High' END AS speaker_label,
              CASE WHEN s.env THEN 'environmental' WHEN c.clip IS NULL THEN 'Audio too short' END AS kept_because
       FROM s LEFT JOIN c ON s.clip = c.clip AND s.k = c.k""",
)
def _(t):
    chunks = t.frames.select(F.col("clip").alias("recording_id"), F.col("frame").alias("chunk_index"), F.array(F.element_at("feat", 3) * 8, F.element_at("feat", 4) * 8).alias("audio"))
    k = F.col("segment_index")
    rows = chunks.select("recording_id").distinct().withColumn("segment_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    rows = rows.select("*", (k * 2 / 16000).alias("start"), ((k * 2 + 3) / 16000).alias("end"), F.lit(7).alias("speaker_id"), F.lit("old").alias("speaker_label"), (k % 4 == 3).alias("is_environmental"))
    people = t.spark.createDataFrame(HEARD, "idx int, name string, centroid array<double>")
    return J.process_quick_audio(rows, chunks, sample_scorer, people, SURE, GATES, min_samples=3).select("recording_id", "segment_index", "speaker_label", "kept_because")


#: Other gates than those the segments were inferred with, and the same in SQL.
LOOSE = replace(GATES, boost=1.3, unknown_boost=1.2, confident=0.5, ambiguity_margin=0.12)
LOOSE_BOOST = BOOST.replace("s1 >= 0.4", "s1 >= 0.5").replace("s1 - s2 >= 0.08", "s1 - s2 >= 0.12").replace("THEN 1.05 ELSE 1.10", "THEN 1.2 ELSE 1.3")
OTHER_BOOST = re.sub(r"\b(ranked|assigned)\b", r"other_\1", BOOST)


@query("C14_reapply_boosting", f"WITH {LOOSE_BOOST} SELECT display_label, count(*) AS n FROM att GROUP BY display_label")
def _(t):
    return J.reapply_boosting(segments(t), LOOSE).groupBy("display_label").agg(F.count(F.lit(1)).alias("n"))


@query("C14_switch_enrollments", f"WITH {OTHER_BOOST} SELECT recording_id, display_label, count(*) AS n FROM att GROUP BY ALL")
def _(t):
    return J.switch_enrollments(segments(t), roster(t).where("enrollment_id <> 0"), SCALED, GATES).groupBy("recording_id", "display_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C15_job_grid",
    "SELECT a.recording_id, g.job_id, count(*) FILTER (WHERE similarity >= g.threshold) AS n_sure FROM assigned a, (SELECT 'a' AS job_id, CAST(0.1 AS DOUBLE) AS threshold UNION ALL SELECT 'b', 0.2 UNION ALL SELECT 'c', 0.3) g GROUP BY ALL",
)
def _(t):
    settings = t.spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "job_id string, threshold double")
    rows = J.job_grid(segments(t).select("recording_id", "similarity"), settings)
    return rows.groupBy("recording_id", F.col("settings.job_id").alias("job_id")).agg(F.count_if(F.col("similarity") >= F.col("settings.threshold")).alias("n_sure"))


#: Three jobs: the usual settings, laxer assignment, other gates of the inference.
GRID = "job_id string, similarity double, margin double, boost double, confident double, ambiguity_margin double"
JOBS = [("usual", 0.2, 0.02, 1.10, 0.4, 0.08), ("lax", 0.1, 0.0, 1.10, 0.4, 0.08), ("loose", 0.2, 0.02, 1.3, 0.5, 0.12)]


def grid_sql() -> str:
    """Each job's rows from the same SQL under its own numbers."""
    parts = []
    for job, similarity, margin, boost, confident, ambiguity in JOBS:
        assigned = SQL["assigned"].replace("similarity >= 0.2", f"similarity >= {similarity}").replace("margin >= 0.02", f"margin >= {margin}").replace("margin < 0.02", f"margin < {margin}")
        own = BOOST.replace("s1 >= 0.4", f"s1 >= {confident}").replace("s1 - s2 >= 0.08", f"s1 - s2 >= {ambiguity}").replace("ELSE 1.10 END", f"ELSE {boost} END")
        parts.append(f"SELECT '{job}' AS job_id, * FROM (WITH assigned AS ({assigned}), {own} SELECT recording_id, segment_index, speaker_label, display_label, skip AS skip_reason, was_influenced FROM att)")
    return " UNION ALL ".join(parts)


@query("C15_process_grid", grid_sql())
def _(t):
    order = Window.partitionBy("recording_id").orderBy("ord")
    rows = voices(t).withColumn("segment_index", F.row_number().over(order) - 1)
    out = J.process_grid(rows, roster(t), t.spark.createDataFrame(JOBS, GRID), SCALED, GATES)
    return out.select("job_id", "recording_id", "segment_index", "speaker_label", "display_label", "skip_reason", "was_influenced")


@query("U2_segment_acoustic", "SELECT recording_id, count(*) AS n_phrases, CAST(sum(n_words) AS BIGINT) AS n_words FROM (SELECT recording_id, island, sum(n_words) AS n_words FROM (SELECT *, sum(CASE WHEN phrase_id = 0 OR \"end\" - \"start\" >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY phrase_id) AS island FROM speaker_runs) GROUP BY ALL) GROUP BY recording_id")
def _(t):
    out = J.segment(t.event_words, ["recording_id"], "acoustic", t.seg_spans, {"min_duration": 3600.0, "bucket": 7200.0})
    return out.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_phrases"), F.sum("n_words").alias("n_words"))


@query("U1_embed", "SELECT clip, CASE WHEN count(*) < 3 THEN 'Audio too short' END AS error, CASE WHEN count(*) >= 3 THEN round(avg(feat[3]), 6) END AS mean FROM frames GROUP BY clip")
def _(t):
    audio = t.frames.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "feat"))), lambda s: F.element_at(s["feat"], 3)).alias("audio"))
    return J.embed(audio, sample_scorer, 3).select("clip", "error", r6(F.col("embedding")[0]).alias("mean"))


@query("C16_merge_transcript")
def _(t):
    words = t.marked_words.withColumn("text", F.concat(F.lit(" "), F.col("text")))
    phrases = detect_phrases(words, CHUNK)
    number = F.pmod(F.xxhash64(*CHUNK, "phrase_id"), F.lit(t.n_voices)).alias("v")
    vectors = t.voices.select(F.col("ord").alias("v"), "embedding")
    rows = phrases.select("*", number).join(vectors, "v", "left").withColumn("embedding", F.when(F.col("phrase_id") % 4 != 3, F.col("embedding")))
    said = words.groupBy(*CHUNK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), "").alias("text"), F.max_by("end", "pos").alias("end"))
    out = merge_transcript(rows, roster(t), 10.0 * F.col("chunk_index"), CHUNK, SCALED, transcripts=said)
    return out.select(*CHUNK, "phrase_id", "kind", "speaker_id", r6("start_time").alias("start_time"), "text")


#: Up to so many voices are broadcast to the phrases (about 300 bytes each); beyond, phrases are shuffled to meet them.
BROADCAST_VOICES = 300_000


@query("C12_process_full")
def _(t):
    chunks = t.overlap_chunks.withColumn("words", F.transform("words", lambda w: w.withField("text", F.concat(F.lit(" "), w["text"]))))

    def voiced(phrases):
        number = F.pmod(F.xxhash64("recording_id", "chunk_index", "phrase_id"), F.lit(t.n_voices)).alias("v")
        vectors = t.table("embeddings").select(F.col("vec_id").alias("v"), "embedding")
        if t.n_voices <= BROADCAST_VOICES:
            vectors = F.broadcast(vectors)
        return phrases.select("*", number).join(vectors, "v", "left").withColumn("embedding", F.when(F.col("phrase_id") % 4 != 3, doubles(F.col("embedding")))).drop("v")

    out = J.process_full(chunks, voiced, roster(t), folder(t.spark, "full"), SCALED, GATES)
    return out.select("recording_id", "segment_index", "chunk_index", "kind", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), "text", "speaker_id", "speaker_label", r6("similarity").alias("similarity"), "reason", "display_label", "was_influenced")


def event_stream(t):
    return L.chunk_stream(t.spark, f"{t.sf_dir}/event[s].parquet", t.table("events").schema).withColumn("at", F.col("ts").cast("timestamp"))


@query(
    "T6_phrase_windows",
    """SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, i""",
)
def _(t):
    out = L.phrase_windows(event_stream(t), ["user_id"], "at", "6 hours")
    got = L.run_available(out, folder(t.spark, "phrase-windows"), folder(t.spark, "state"), "complete")
    return got.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("T7_audio_level", """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS "start", round(sqrt(avg(value * value)), 6) AS level FROM events GROUP BY ALL""")
def _(t):
    out = L.audio_level(event_stream(t), ["user_id"], "at", "value", "1 day")
    got = L.run_available(out, folder(t.spark, "levels"), folder(t.spark, "state"), "complete")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), r6("level").alias("level"))


#: Speakers of `letter_voices`, whose vectors are counts of letters and so all alike.
LETTERS = Clustering(similarity=0.93, minimum=0.8, margin=0.005, num_speakers=3)
LETTER_GATES = Inference(confident=0.995, ambiguity_margin=0.2, min_for_boost=0.5, min_after_boost=0.6, final_margin=0.01)


@query("T5_live_transcript")
def _(t):
    talk = L.chunk_stream(t.spark, f"{t.sf_dir}/conversation[s].parquet", t.table("conversations").schema)
    store = Store(t.spark, folder(t.spark, "live-store"), TR.TABLES)
    TR.run_live(TR.live_segments(t.talk_chunks(talk), t.letter_voices, [], LETTERS, LETTER_GATES), store, folder(t.spark, "live"), LETTER_GATES)
    out = store.read("segments")
    return out.select("recording_id", "segment_index", "channel_id", "chunk_index", "kind", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), "text", "speaker_label", r6("similarity").alias("similarity"), "reason", "display_label", "was_influenced", "is_late")


@query("T5_live_assignment")
def _(t):
    schema = t.table("embeddings").schema
    rows = L.chunk_stream(t.spark, f"{t.sf_dir}/embedding[s].parquet", schema)
    phrases = rows.select(F.floor(F.col("vec_id") / 25).alias("recording_id"), (F.col("label") % 2).alias("channel_id"), F.col("vec_id").alias("ord"), F.lit(10.0).alias("duration"), F.when(F.col("vec_id") % 25 == 0, 0.0).otherwise(1.5).alias("overlap"), (F.col("vec_id") % 97 == 0).alias("is_final"), F.lit(0.5).alias("start"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = L.live_assignment(phrases, ONLINE)
    return L.run_available(out, folder(t.spark, "live"), folder(t.spark, "state"), "append").withColumn("start_time", r6("start_time"))


@query("T9_log_stream", "SELECT user_id AS session_id, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    logs = event_stream(t).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("type"), "event_id", "props")
    path = folder(t.spark, "log-stream")
    query = L.log_stream(logs, path, folder(t.spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(path).groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))


#: The table's events as chunks of channels, in seconds of wall time; the same in SQL.
WALL = "epoch_us(ts) / 1e6"


def event_chunks(t):
    wall = (F.unix_micros("at") / 1e6).alias("wall_time")
    return event_stream(t).select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel_id"), F.col("event_id").alias("chunk_id"), wall)


@query("S15_chunk_stream", f"SELECT user_id AS recording_id, event_type AS channel_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {WALL}, event_id) - 1 AS arrival FROM events")
def _(t):
    got = L.run_available(event_chunks(t), folder(t.spark, "chunks"), folder(t.spark, "state"), "append")
    order = Window.partitionBy("recording_id", "channel_id").orderBy("wall_time", "chunk_id")
    return got.select("recording_id", "channel_id", "chunk_id", (F.row_number().over(order) - 1).cast("long").alias("arrival"))


@query("T1_ordered_chunks", f"SELECT user_id AS recording_id, event_type AS channel_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY {WALL}, event_id) - 1 AS sequence, false AS is_late FROM events")
def _(t):
    out = L.ordered_chunks(event_chunks(t))
    return L.run_available(out, folder(t.spark, "ordered"), folder(t.spark, "state"), "append").drop("wall_time")


KINDS = {"signup": "start", "click": "speech", "view": "pause", "error": "stop", "purchase": "enroll"}
LIFE = "PARTITION BY recording_id, channel_id ORDER BY wall, event_id"


#: Sessions as groups of each channel's events.
SESSIONS = f"""WITH e AS (SELECT user_id AS recording_id, CAST(event_id % 2 AS INTEGER) AS own, event_id, {WALL} AS wall, event_type AS kind, value FROM events),
       c AS (SELECT e.*, channel_id FROM e, (SELECT 0 AS channel_id UNION ALL SELECT 1) WHERE kind IN ('signup', 'error', 'purchase') OR own = channel_id),
       s AS (SELECT *, coalesce(sum(CAST(kind = 'signup' AS INTEGER)) OVER up, 0) AS session, sum(CAST(kind = 'purchase' AS INTEGER)) OVER up AS n_enrolled,
                    last_value(CASE WHEN kind IN ('signup', 'error') THEN kind END IGNORE NULLS) OVER ({LIFE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
             FROM c WINDOW up AS ({LIFE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       p AS (SELECT *, coalesce(sum(CAST(kind IN ('view', 'error') AS INTEGER)) OVER (PARTITION BY recording_id, channel_id, session ORDER BY wall, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
             FROM s WHERE state = 'signup' AND kind <> 'signup'),
       g AS (SELECT recording_id, session, channel_id, part, max(event_id) FILTER (WHERE kind IN ('view', 'error')) AS last_event, max(wall) FILTER (WHERE kind IN ('view', 'error')) AS wall, sum(value) FILTER (WHERE kind = 'click') AS seconds,
                    bool_or(kind = 'error') AS is_final, max(n_enrolled) AS n_enrolled FROM p GROUP BY ALL)
       SELECT recording_id, CAST(session AS BIGINT) AS session, channel_id, last_event, round(seconds, 6) AS seconds, is_final, row_number() OVER (PARTITION BY recording_id, session, channel_id ORDER BY part) > 1 AS follows, CAST(n_enrolled AS BIGINT) AS n_enrolled
       FROM g WHERE last_event IS NOT NULL AND seconds IS NOT NULL"""


def session_events(t):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return event_stream(t).select(
        F.col("user_id").alias("recording_id"), (F.col("event_id") % 2).cast("int").alias("channel_id"), "event_id", (F.unix_micros("at") / 1e6).alias("wall_time"),
        kind.alias("kind"), F.col("value").alias("seconds"), "at",
    )


@query("T8_session_lifecycle", SESSIONS)
def _(t):
    out = L.session_lifecycle(session_events(t).drop("at"))
    return L.run_available(out, folder(t.spark, "sessions"), folder(t.spark, "state"), "append").withColumn("seconds", r6("seconds"))


#: Seconds without events after which a session ends, and the same in SQL: a stop behind the last event before such a gap.
IDLE = 43_200.0
TIMED = SESSIONS.replace(
    "event_type AS kind, value FROM events)",
    f"""event_type AS kind, value, 0 AS extra FROM events
       UNION ALL SELECT recording_id, own, event_id, wall, 'error', NULL, 1 FROM (
           SELECT user_id AS recording_id, CAST(event_id % 2 AS INTEGER) AS own, event_id, {WALL} AS wall,
                  coalesce(lead({WALL}) OVER (PARTITION BY user_id ORDER BY {WALL}, event_id), (SELECT max({WALL}) FROM events)) AS after FROM events) WHERE after - wall >= {IDLE})""",
).replace("ORDER BY wall, event_id", "ORDER BY wall, event_id, extra")


@query("T8_timed_sessions", TIMED)
def _(t):
    TR.keyed_state(t.spark)
    out = timed_sessions(session_events(t), IDLE)
    return L.run_available(out, folder(t.spark, "timed"), folder(t.spark, "state"), "append").withColumn("seconds", r6("seconds"))


#: The table's events as frames of one channel, some of them final; speech runs and the pieces they are cut into in SQL.
SPEECH = """WITH f AS (SELECT user_id AS recording_id, event_id AS frame, ((event_id * 7919) % 101) / CAST(100 AS DOUBLE) AS p, event_type = 'error' AS final FROM events),
       l AS (SELECT *, coalesce(max(CASE WHEN p >= 0.35 THEN frame END) OVER (PARTITION BY recording_id ORDER BY frame), -1) AS loud,
                    coalesce(sum(CAST(final AS INTEGER)) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM f),
       e AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN 1 WHEN frame - loud >= 300 THEN 0 END IGNORE NULLS) OVER (PARTITION BY recording_id, part ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM l),
       n AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY recording_id, part ORDER BY frame), 0) = 0 THEN 1 ELSE 0 END AS b FROM e),
       s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY recording_id ORDER BY frame) AS BIGINT) - 1 AS segment_index, max(frame) OVER (PARTITION BY recording_id) AS newest FROM n),
       r AS (SELECT recording_id, segment_index, greatest(CAST(0 AS DOUBLE), min(frame) * CAST(0.1 AS DOUBLE) - CAST(0.15 AS DOUBLE)) AS b, (max(frame) + 1) * CAST(0.1 AS DOUBLE) AS e,
                    max(frame) = any_value(newest) AND NOT bool_or(final) AS is_open, (max(frame) + 1 - min(frame)) * CAST(0.1 AS DOUBLE) AS heard FROM s WHERE st = 1 GROUP BY ALL),
       c AS (SELECT *, CASE WHEN e - b > CAST(1.1 AS DOUBLE) * longest THEN CAST(ceil((e - b) / longest) AS BIGINT) ELSE 1 END AS n FROM r, (SELECT CAST({longest} AS DOUBLE) AS longest)),
       q AS (SELECT *, unnest(range(0, n)) AS piece FROM c WHERE heard >= 0.3)
       SELECT recording_id, CAST(0 AS BIGINT) AS channel_id, segment_index, piece, round(b + piece * longest - CASE WHEN piece > 0 THEN 1.5 ELSE 0 END, 6) AS "start", round(CASE WHEN piece = n - 1 THEN e ELSE b + piece * longest + longest END, 6) AS "end",
              CAST(CASE WHEN piece > 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS overlap, piece < n - 1 AS forced
       FROM q WHERE CASE WHEN piece = n - 1 THEN e ELSE b + piece * longest + longest END - (b + piece * longest) >= 0.3 AND NOT (is_open AND piece = n - 1)"""


def live_speech(t, longest: float | None):
    TR.keyed_state(t.spark)
    p = (F.col("event_id") * 7919 % 101 / 100.0).alias("p")
    frames = event_stream(t).select(F.col("user_id").alias("recording_id"), F.lit(0).alias("channel_id"), F.col("event_id").alias("frame"), p, (F.col("event_type") == "error").alias("is_final"))
    got = L.run_available(speech_pieces(frames, 0.1, hold=30.0, longest=longest), folder(t.spark, "speech"), folder(t.spark, "state"), "append")
    return got.withColumns({"start": r6("start"), "end": r6("end")})


@query("T2_live_speech", SPEECH.replace("{longest}", "1e12"))
def _(t):
    return live_speech(t, None)


@query("T3_live_pieces", SPEECH.replace("{longest}", "60"))
def _(t):
    return live_speech(t, 60.0)


@query("T6_word_phrases", """SELECT recording_id, chunk_index, round("start", 6) AS "start", round("end", 6) AS "end", n_words FROM phrases""")
def _(t):
    talk = L.chunk_stream(t.spark, f"{t.sf_dir}/conversation[s].parquet", t.table("conversations").schema)
    out = L.word_phrases(t.timed_words(talk).withColumnRenamed("turn", "chunk_index"), ["recording_id", "chunk_index"])
    got = L.run_available(out, folder(t.spark, "word-phrases"), folder(t.spark, "state"), "complete")
    return got.withColumns({"start": r6("start"), "end": r6("end")}).withColumnRenamed("n", "n_words")
