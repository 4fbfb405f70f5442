"""Recordings, jobs and logs: orders stand in for recordings, events for logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxspark.functions import text as X
from voxspark.operators import inference as I
from voxspark.operators.beside import beside
from voxspark.operators.overlap import align_overlap
from voxspark.plans.folders import folder
from voxspark.plans.q_inference import BOOST, inferred
from voxspark.plans.q_phrases import CHUNK, J5, with_previous
from voxspark.plans.q_speakers import r6, roster
from voxspark.plans.q_text import TRIMMED
from voxspark.plans.registry import query
from voxspark.sources import recordings as R
from voxspark.sources.snapshots import Store


def asr_chunks(t):
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end"))), lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end")))
    return t.words.groupBy(*CHUNK).agg(F.struct(words.alias("all_words")).alias("raw_asr"))


@query("S1_read_words", """SELECT recording_id, channel_id, chunk_index, pos, text, "start", "end" FROM words""")
def _(t):
    return R.read_words(asr_chunks(t))


@query(
    "S2_read_audio_chunks",
    """WITH c AS (SELECT recording_id, chunk_index, channel_id, max("end") AS w, count(*) AS n FROM words GROUP BY ALL)
       SELECT recording_id, channel_id, CASE WHEN recording_id % 2 = 0 THEN row_number() OVER (PARTITION BY recording_id ORDER BY chunk_index) - 1 ELSE row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN chunk_index % 3 = 0 THEN 0 ELSE w END, channel_id, chunk_index) - 1 END AS position, n AS n_samples FROM c""",
)
def _(t):
    wall = F.when(F.col("chunk_index") % 3 != 0, F.col("w"))
    c = t.words.groupBy(*CHUNK).agg(F.max("end").alias("w"), F.count(F.lit(1)).alias("n"))
    one = F.struct("chunk_index", "channel_id", F.lit(None).cast("double").alias("overlap"), F.lit(None).cast("boolean").alias("is_final"), wall.alias("wall_time"), F.col("n").alias("n_samples"))
    listed = c.where("recording_id % 2 = 0").groupBy("recording_id").agg(F.array_sort(F.collect_list(one)).alias("chunk_list"))
    mapped = c.where("recording_id % 2 = 1").groupBy("recording_id", "channel_id").agg(F.array_sort(F.collect_list(one)).alias("l")).groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("channel_id").cast("string"), "l"))).alias("chunk_map"))
    both = listed.withColumn("chunk_map", F.lit(None).cast(mapped.schema["chunk_map"].dataType)).unionByName(mapped.withColumn("chunk_list", F.lit(None).cast(listed.schema["chunk_list"].dataType)))
    return R.read_audio_chunks(both).select("recording_id", "channel_id", F.col("position").cast("long").alias("position"), "n_samples")


@query("S5_list_recordings", "SELECT id, status, created_at, duration FROM recordings")
def _(t):
    return R.list_recordings(t.recordings)


@query("F4_newest_first", "SELECT id, created_at FROM recordings ORDER BY created_at DESC, id LIMIT 20")
def _(t):
    return R.newest_first(t.recordings.select("id", "created_at"), "created_at", 20)


@query("S6_read_session_logs", "SELECT session_id, log_id, type, row_number() OVER (PARTITION BY session_id ORDER BY ts, log_id) AS n FROM logs")
def _(t):
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "log_id")).cast("long")
    return R.read_session_logs(t.logs).select("session_id", "log_id", "type", n.alias("n"))


@query("S7_append_log", """SELECT conv_id AS session_id, turn, '{"turn":' || turn || ',"role":"' || role || '","n":' || length(text[1:100]) || '}' AS data FROM conversations""")
def _(t):
    c = t.table("conversations").select(F.col("conv_id").alias("session_id"), F.lit(None).cast("timestamp").alias("ts"), "turn", "role", F.char_length(F.substring("text", 1, 100)).alias("n"))
    return R.log_rows(c, "whisper", ["turn", "role", "n"]).select("session_id", F.get_json_object("data", "$.turn").cast("long").alias("turn"), "data")


@query(
    "S9_export_text",
    """SELECT recording_id, string_agg(CASE WHEN segment_index % 7 = 3 THEN '' ELSE speaker || ' ' END || '[' || CAST(floor(value / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' - ' || CAST(floor((value + 90) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(value + 90) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ']: ' || props, chr(10) ORDER BY segment_index) AS text
       FROM segments JOIN events USING (event_id) GROUP BY recording_id""",
)
def _(t):
    e = t.table("events").select("event_id", "value", "props")
    s = t.segments.join(e, "event_id").select("recording_id", "segment_index", F.col("value").alias("start"), (F.col("value") + 90).alias("end"), F.col("speaker").alias("label"), (F.col("segment_index") % 7 == 3).alias("is_environmental"), F.col("props").alias("text"))
    return R.export_text(s, ["recording_id"])


@query(
    "S8_export_job_json",
    """SELECT recording_id AS job_id, count(*) AS n_segments, count(*) FILTER (WHERE segment_index % 5 = 0) AS n_changed, min_by(speaker, segment_index) AS first_label FROM segments GROUP BY recording_id""",
)
def _(t):
    s = t.segments.select(F.col("recording_id").alias("job_id"), "segment_index", F.col("speaker").alias("speaker_label"), F.col("speaker").alias("effective_speaker"), (F.col("segment_index") % 5 == 0).alias("was_influenced"))
    jobs = s.select("job_id").distinct().withColumn("name", F.concat(F.lit("Job "), F.col("job_id").cast("string")))
    j = lambda p, kind: F.get_json_object("json", p).cast(kind)
    return R.export_job_json(jobs, s).select("job_id", j("$.stats.n_segments", "long").alias("n_segments"), j("$.stats.n_changed", "long").alias("n_changed"), j("$.segments[0].speaker_label", "string").alias("first_label"))


@query("S10_migrate_v1_to_v2", "SELECT id, CASE WHEN id % 3 = 2 THEN 'later' ELSE 'Original Processing' END AS job_name, CASE WHEN id % 3 = 2 THEN id || '-own' ELSE id || '-job-1' END AS active_job_id, CASE WHEN id % 3 = 2 THEN 'm9' WHEN id % 4 = 0 THEN 'm1' ELSE 'default' END AS model_id FROM recordings")
def _(t):
    own = F.struct(F.concat(F.col("id").cast("string"), F.lit("-own")).alias("id"), F.lit("later").alias("name"), F.lit("processed").alias("status"), F.lit("m9").alias("model_id"), F.array("status").alias("participants"))
    is2 = F.col("id") % 3 == 2
    old = t.recordings.select("id", F.when(is2, 2).when(F.col("id") % 3 == 1, 1).alias("schema_version"), F.when(F.col("id") % 4 == 0, "m1").alias("model_id"), F.array("status").alias("participants"), F.when(is2, F.array(own)).alias("jobs"), F.when(is2, F.concat(F.col("id").cast("string"), F.lit("-own"))).alias("active_job_id"))
    return R.migrate_v1_to_v2(old).select("id", F.col("jobs")[0]["name"].alias("job_name"), "active_job_id", F.col("jobs")[0]["model_id"].alias("model_id"))


@query("S11_upsert_by_key", "SELECT id, CASE WHEN id % 5 = 0 THEN 'X' ELSE status END AS status FROM recordings UNION ALL SELECT DISTINCT -owner, 'N' FROM recordings WHERE owner % 10 = 0")
def _(t):
    old = t.recordings.select("id", "status")
    new = old.where("id % 5 = 0").withColumn("status", F.lit("X")).unionByName(t.recordings.where("owner % 10 = 0").select((-F.col("owner")).alias("id")).distinct().withColumn("status", F.lit("N")))
    return R.upsert_by_key(old, new, "id")


@query("S11_delete_cascade", "SELECT 'recording' AS kind, count(*) AS n FROM recordings WHERE owner % 3 <> 0 UNION ALL SELECT 'chunk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM recordings WHERE owner % 3 = 0)")
def _(t):
    r = t.recordings
    left, chunks = R.delete_by_key(r, t.table("lineitem").select("l_orderkey"), r.where("owner % 3 = 0"), "id", "l_orderkey")
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(left, "recording").unionByName(one(chunks, "chunk"))


@query("S12_retain_latest_n", "SELECT id FROM recordings ORDER BY created_at DESC, id LIMIT 20")
def _(t):
    return R.retain_latest_n(t.recordings.select("id", "created_at"), "created_at", "id", 20).select("id")


@query(
    "S12_retain_with_children",
    """WITH k AS (SELECT id FROM recordings ORDER BY created_at DESC, id LIMIT 20)
       SELECT 'recording' AS kind, CAST(id AS BIGINT) AS id, NULL::BIGINT AS n FROM k
       UNION ALL SELECT 'chunks', l_orderkey, count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM k) GROUP BY l_orderkey
       UNION ALL SELECT 'deleted', NULL, greatest(0, count(*) - 20) FROM recordings""",
)
def _(t):
    kept, children, deleted = R.retain_with_children(t.recordings.select("id", "created_at"), {"chunks": t.table("lineitem").select("l_orderkey", "l_linenumber")}, "created_at", "id", "l_orderkey", 20)
    one = kept.select(F.lit("recording").alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("n"))
    two = children["chunks"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunks").alias("kind"), F.col("l_orderkey").cast("long").alias("id"), "n")
    return one.unionByName(two).unionByName(t.spark.createDataFrame([("deleted", None, deleted)], "kind string, id long, n long"))


@query(
    "S13_export_raw_chunks",
    f"""WITH c AS (SELECT recording_id, chunk_index, count(*) AS n_words, max_by(text, pos) AS last_word, any_value(overlap) AS overlap FROM overlap_words GROUP BY ALL)
        SELECT recording_id, chunk_index, n_words, last_word, overlap, merge_index, method FROM c JOIN ({J5}) USING (recording_id, chunk_index)""",
)
def _(t):
    rows = R.export_raw_chunks(align_overlap(with_previous(t)))
    # read back as its readers would
    shape = "chunk_index long, raw_asr struct<all_words:array<struct<text:string>>>, overlap double, merge_info struct<merge_index:int,method:string>"
    j = rows.select("recording_id", F.from_json("json", shape).alias("j"))
    words = F.col("j.raw_asr.all_words")
    return j.select("recording_id", "j.chunk_index", F.size(words).cast("long").alias("n_words"), F.element_at(words, -1)["text"].alias("last_word"), "j.overlap", "j.merge_info.merge_index", "j.merge_info.method")


@query("S13_export_transcript_json", """SELECT recording_id, segment_index, round("start", 3) AS "start", speaker, confidence FROM segments""")
def _(t):
    rows = R.export_transcript_json(t.segments.select("recording_id", F.col("segment_index").cast("long").alias("segment_index"), "start", "end", "speaker", "confidence"))
    j = F.from_json("json", "segment_index long, start double, speaker string, confidence double").alias("j")
    return rows.select("recording_id", j).select("recording_id", "j.segment_index", F.round("j.start", 3).alias("start"), "j.speaker", "j.confidence")


@query(
    "S8_export_job_document",
    f"""WITH {BOOST}, e AS (SELECT *, CASE WHEN was_influenced THEN best_name ELSE coalesce(display_label, speaker_label) END AS effective FROM att),
        n AS (SELECT recording_id, effective, count(*) AS n FROM e GROUP BY ALL)
        SELECT recording_id, count(*) AS n_segments, count(*) FILTER (WHERE done) AS n_boosted, count(*) FILTER (WHERE was_influenced) AS n_changed, any_value(p) AS n_participants, any_value(who) AS first_participant,
               (SELECT count(*) FROM roster) AS n_enrolled, min_by(n1, segment_index) AS first_candidate, max_by(effective, segment_index) AS last_speaker, max_by(display_label, segment_index) AS last_display
        FROM e JOIN (SELECT recording_id, count(*) AS p, min_by(effective, (-n, effective)) AS who FROM n GROUP BY recording_id) USING (recording_id) GROUP BY recording_id""",
)
def _(t):
    rows = I.effective_speaker(inferred(t)).withColumn("job_id", F.concat(F.lit("job-"), F.col("recording_id").cast("string")))
    segments = rows.select("job_id", "segment_index", "speaker_label", "effective_speaker", "similarity", "candidates", "display_label", "boosted", "was_influenced")
    jobs = rows.select("job_id", "recording_id").distinct().withColumn("status", F.lit("processed"))
    recordings = jobs.select("recording_id", F.col("job_id").alias("active_job_id"))
    one = F.transform(F.array_sort(F.collect_list("name")), lambda n: n)
    names = beside(jobs.select("job_id"), roster(t), roster(t).agg(one.alias("names")))
    out = R.export_job_document(jobs, recordings, names.select("job_id", F.explode("names").alias("name")), segments)
    shape = (
        "job struct<recording_id:long>, enrollments array<struct<name:string>>, stats struct<n_segments:long,n_boosted:long,n_changed:long,n_participants:long>, participants array<struct<name:string>>, "
        "segments array<struct<effective_speaker:string,candidates:array<struct<name:string>>,attribution:struct<display_label:string>>>"
    )
    j = out.select(F.from_json("json", shape).alias("j"))
    first, last = F.element_at("j.segments", 1), F.element_at("j.segments", -1)
    return j.select(
        "j.job.recording_id", "j.stats.n_segments", "j.stats.n_boosted", "j.stats.n_changed", "j.stats.n_participants", F.element_at("j.participants", 1)["name"].alias("first_participant"),
        F.size("j.enrollments").cast("long").alias("n_enrolled"), F.element_at(first["candidates"], 1)["name"].alias("first_candidate"), last["effective_speaker"].alias("last_speaker"), last["attribution"]["display_label"].alias("last_display"),
    )


@query("S13_export_session_logs", "SELECT session_id, count(*) AS n, count(*) FILTER (WHERE type = 'error') AS n_errors FROM logs GROUP BY session_id")
def _(t):
    return t.logs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "error").alias("n_errors"))


@query("S14_save_session", """SELECT recording_id, round(max_by("end", segment_index), 3) AS duration, count(*) AS n_segments, count(DISTINCT speaker) AS n_participants, any_value(n) AS n_chunks FROM segments JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = recording_id GROUP BY recording_id""")
def _(t):
    return R.save_session(t.segments, t.table("conversations").withColumnRenamed("conv_id", "recording_id")).withColumn("duration", F.round("duration", 3))


@query(
    "S14_session_tables",
    """WITH c AS (SELECT conv_id AS recording_id, turn AS chunk_index, length(text) AS n_samples FROM conversations), b AS (SELECT recording_id, count(*) AS n, CAST(sum(n_samples) AS BIGINT) AS s FROM c GROUP BY ALL),
       r AS (SELECT recording_id, max_by("end", segment_index) AS duration, count(*) AS n, list_sort(list(DISTINCT speaker)) AS p FROM segments WHERE recording_id IN (SELECT recording_id FROM c) GROUP BY recording_id)
       SELECT 'recordings' AS kind, r.recording_id, NULL::BIGINT AS item, round(duration, 3) AS amount, CAST(r.n AS VARCHAR) || '/' || b.n || '/' || len(p) || '/' || CAST(round(CAST(1.2 AS DOUBLE) * 4 * b.s) AS BIGINT) AS detail FROM r JOIN b USING (recording_id)
       UNION ALL SELECT 'jobs', recording_id, NULL, NULL, recording_id || '-job-1 processed ' || array_to_string(p, ',') FROM r
       UNION ALL SELECT 'segments', recording_id, segment_index, round("start", 3), speaker FROM segments WHERE recording_id IN (SELECT recording_id FROM r)
       UNION ALL SELECT 'chunks', recording_id, chunk_index, CAST(n_samples AS DOUBLE), NULL FROM c WHERE recording_id IN (SELECT recording_id FROM r)""",
)
def _(t):
    store = Store(t.spark, folder(t.spark, "sessions-store"), R.SESSION_TABLES)
    s = t.segments.select("recording_id", F.col("segment_index").cast("long").alias("segment_index"), "start", "end", "speaker")
    c = t.table("conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("chunk_index"), F.char_length("text").cast("long").alias("n_samples"))
    R.save_sessions(store, 0, s.select("recording_id").distinct().withColumn("model_id", F.lit("default")), s, c)
    none = lambda kind: F.lit(None).cast(kind)
    rec, jobs, seg, chk = (store.read(n) for n in ("recordings", "jobs", "segments", "chunks"))
    shape = lambda df, kind, item, amount, detail: df.select(F.lit(kind).alias("kind"), "recording_id", item.alias("item"), amount.alias("amount"), detail.alias("detail"))
    numbers = F.concat_ws("/", *[F.col(x).cast("string") for x in ("n_segments", "n_chunks", "n_participants", "size")])
    return (
        shape(rec, "recordings", none("long"), F.round("duration", 3), numbers)
        .unionByName(shape(jobs, "jobs", none("long"), none("double"), F.concat_ws(" ", "job_id", "status", F.array_join("participants", ","))))
        .unionByName(shape(seg, "segments", F.col("segment_index"), F.round("start", 3), F.col("speaker")))
        .unionByName(shape(chk, "chunks", F.col("chunk_index"), F.col("n_samples").cast("double"), none("string")))
    )


@query("J9_active_job", "SELECT id, status, 'j' || (id % 3) AS job_id FROM recordings WHERE id % 3 <> 2")
def _(t):
    rec = t.recordings.withColumn("active_job_id", F.concat(F.lit("j"), (F.col("id") % 3).cast("string")))
    jobs = t.recordings.select(F.col("id").alias("recording_id"), F.explode(F.array(F.lit("j0"), F.lit("j1"))).alias("job_id"))
    return R.active_job(rec, jobs).select("id", "status", "job_id")


@query("J9_recording_with_chunks", "SELECT r.id, coalesce(c.chunks, []) AS chunks FROM recordings r LEFT JOIN (SELECT conv_id, list(turn ORDER BY turn) AS chunks FROM conversations GROUP BY conv_id) c ON c.conv_id = r.id")
def _(t):
    chunks = t.table("conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").cast("long").alias("chunk_index"))
    return R.recording_with_chunks(t.recordings, chunks).select("id", F.col("chunks").cast("array<long>").alias("chunks"))


@query("J14_channel_config", "SELECT DISTINCT recording_id, channel_id, CASE WHEN channel_id = 0 AND recording_id % 2 = 0 THEN 'Mic' ELSE 'Input ' || (channel_id + 1) END AS channel_label, CASE WHEN channel_id = 0 AND recording_id % 2 = 0 THEN 1 ELSE 2 END AS expected_speakers FROM words")
def _(t):
    c = t.words.select("recording_id", "channel_id").distinct()
    config = c.where("channel_id = 0 AND recording_id % 2 = 0").withColumns({"channel_label": F.lit("Mic"), "expected_speakers": F.lit(1)})
    return R.channel_config(c, config)


@query("E12_global_segment_index", """SELECT recording_id, chunk_seq, pos, row_number() OVER (PARTITION BY recording_id ORDER BY chunk_seq, "start", kind, pos) - 1 AS segment_index FROM (SELECT recording_id, chunk_index AS chunk_seq, pos, CAST("start" AS BIGINT) AS "start", pos % 2 AS kind FROM words)""")
def _(t):
    rows = t.words.select("recording_id", F.col("chunk_index").alias("chunk_seq"), "pos", F.bround("start").cast("long").alias("start"), (F.col("pos") % 2).alias("kind"))
    return R.global_segment_index(rows, ["recording_id"]).drop("start", "kind")


@query("E15_chunk_order", """SELECT recording_id, channel_id, chunk_index, row_number() OVER (PARTITION BY recording_id ORDER BY w, channel_id, chunk_index) - 1 AS processing_order FROM (SELECT recording_id, channel_id, chunk_index, max("end") AS w FROM words GROUP BY ALL)""")
def _(t):
    c = t.words.groupBy(*CHUNK).agg(F.max("end").alias("wall_time"))
    return R.chunk_order(c, ["recording_id"]).select(*CHUNK, F.col("processing_order").cast("long").alias("processing_order"))


@query("F3_chronological_segments", """SELECT recording_id, segment_index, round("start", 3) AS "start" FROM segments""")
def _(t):
    return t.segments.select("recording_id", "segment_index", F.round("start", 3).alias("start")).orderBy("recording_id", "start")


@query("G2_append_segments", "SELECT recording_id, speaker, count(*) AS n FROM (SELECT recording_id, speaker FROM segments UNION ALL SELECT recording_id, 'S' || label FROM voices) GROUP BY ALL")
def _(t):
    both = t.segments.select("recording_id", "speaker").unionByName(t.voices.select("recording_id", F.concat(F.lit("S"), F.col("label").cast("string")).alias("speaker")))
    return both.groupBy("recording_id", "speaker").agg(F.count(F.lit(1)).alias("n"))


@query("A26_log_counts", "SELECT session_id, count(*) AS n_logs, min(ts) AS started_at, max(ts) AS ended_at FROM logs GROUP BY session_id")
def _(t):
    return R.log_counts(t.logs)


@query("A27_storage_size", "SELECT clip, CAST(round(1.2 * (100 * count(*) + 4 * 4 * count(*) + 7)) AS BIGINT) AS size FROM frames GROUP BY clip")
def _(t):
    n = F.count(F.lit(1))
    return t.frames.groupBy("clip").agg(n.alias("n")).select("clip", R.storage_size(4 * F.col("n"), 100 * F.col("n"), F.lit(7)).alias("size"))


@query("A28_stage_timings", "SELECT session_id, type, round(sum(value), 6) AS total_ms, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM logs GROUP BY ALL")
def _(t):
    return R.stage_timings(t.logs).withColumns({"total_ms": r6("total_ms"), "mean_ms": r6("mean_ms")})


@query("P21_validate_job_settings", "SELECT id, id % 4 <> 1 AND id % 5 <> 0 AS is_valid FROM recordings")
def _(t):
    model = F.when(F.col("id") % 4 != 1, F.struct(F.lit("m").alias("id"), F.when(F.col("id") % 5 != 0, "name").otherwise("").alias("name")))
    jobs = t.recordings.select("id", F.struct(model.alias("model"), F.lit(0.5).alias("threshold")).alias("settings"))
    return R.validate_job_settings(jobs, ["model", "threshold"]).select("id", "is_valid")


@query(
    "P18_build_segment",
    f"""SELECT recording_id, chunk_index, phrase_id, round(o + "start", 6) AS start_time, round(o + "end", 6) AS end_time, {TRIMMED} AS text, n_words FROM (SELECT *, 10.0 * chunk_index AS o FROM phrases)""",
)
def _(t):
    from voxspark.operators.phrases import detect_phrases
    from voxspark.plans.transcript import build_segments

    rows = build_segments(detect_phrases(t.words, CHUNK), 10.0 * F.col("chunk_index"))
    return rows.select("recording_id", "chunk_index", "phrase_id", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), "text", F.size("words").alias("n_words"))


@query(
    "J6_validate_transcription",
    r"""WITH e AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w, count(*) OVER () AS n FROM benchmark),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, round(len([x for x in e.w if list_contains(d.w, x)]) / CAST(len(e.w) AS DOUBLE), 6) AS ratio, len([x for x in e.w if list_contains(d.w, x)]) / CAST(len(e.w) AS DOUBLE) >= 0.7 AS passed FROM d JOIN e ON e.item_id = doc_id % n""",
)
def _(t):
    from voxspark.plans.transcript import validate_transcription

    n = t.table("benchmark").count()
    b = t.table("benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("expected"))
    rows = t.table("documents").select("doc_id", (F.col("doc_id") % n).alias("k"), F.col("text").alias("transcribed")).join(b, "k")
    return validate_transcription(rows).select("doc_id", r6("ratio").alias("ratio"), "passed")


@query(
    "H15_join_split_markers",
    """WITH RECURSIVE t AS (SELECT recording_id, chunk_index, pos, CASE WHEN pos % 9 = 2 THEN '[' || text WHEN pos % 9 = 4 THEN text || ']' ELSE text END AS text FROM words),
       m AS (SELECT *, starts_with(trim(text), '[') AND NOT ends_with(trim(text), ']') AS opens, min(CASE WHEN ends_with(trim(text), ']') THEN pos END) OVER (PARTITION BY recording_id, chunk_index ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closer FROM t),
       r AS (SELECT recording_id, chunk_index, pos AS first, CASE WHEN opens THEN coalesce(closer, pos) ELSE pos END AS last FROM m WHERE pos = 0
             UNION ALL SELECT m.recording_id, m.chunk_index, m.pos, CASE WHEN opens THEN coalesce(closer, pos) ELSE pos END FROM r JOIN m ON m.recording_id = r.recording_id AND m.chunk_index = r.chunk_index AND m.pos = r.last + 1),
       g AS (SELECT r.recording_id, r.chunk_index, first, string_agg(text, '' ORDER BY pos) AS text FROM r JOIN m ON m.recording_id = r.recording_id AND m.chunk_index = r.chunk_index AND pos BETWEEN first AND last GROUP BY ALL)
       SELECT recording_id, chunk_index, count(*) AS n_words, string_agg(text, '|' ORDER BY first) AS text FROM g GROUP BY ALL""",
)
def _(t):
    from voxspark.plans.transcript import join_split_markers

    p = F.col("pos")
    text = F.when(p % 9 == 2, F.concat(F.lit("["), F.col("text"))).when(p % 9 == 4, F.concat(F.col("text"), F.lit("]"))).otherwise(F.col("text"))
    words = t.words.withColumn("text", text).groupBy("recording_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end"))).alias("words"))
    out = words.select("recording_id", "chunk_index", join_split_markers(F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end")))).alias("w"))
    return out.select("recording_id", "chunk_index", F.size("w").alias("n_words"), F.array_join(F.transform("w", lambda x: x["text"]), "|").alias("text"))
