"""Readers, writers and keyed changes of recordings, jobs, segments and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxspark.functions.text import format_time
from voxspark.sources.snapshots import Store, Table

WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
ASR_CHUNK = T.StructType([
    T.StructField("recording_id", T.StringType()), T.StructField("channel_id", T.IntegerType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("overlap", T.DoubleType()), T.StructField("raw_asr", T.StructType([T.StructField("all_words", T.ArrayType(WORD))])),
])


def read_words(chunks: DataFrame) -> DataFrame:
    """One row a word with its place in the chunk."""
    return chunks.select("recording_id", "channel_id", "chunk_index", F.posexplode("raw_asr.all_words").alias("pos", "w")).select("recording_id", "channel_id", "chunk_index", "pos", "w.text", "w.start", "w.end")


def read_asr_json(spark: SparkSession, path: str) -> DataFrame:
    return read_words(spark.read.schema(ASR_CHUNK).json(path))


def read_audio_chunks(recordings: DataFrame) -> DataFrame:
    """Chunks from an array (its order stays) or from a map of channels (by wall time, missing as 0), with defaults."""
    listed = recordings.where("chunk_list IS NOT NULL").select("recording_id", F.lit(0).alias("__channel"), F.posexplode("chunk_list").alias("__at", "c"))
    mapped = recordings.where("chunk_list IS NULL AND chunk_map IS NOT NULL").select("recording_id", F.explode("chunk_map").alias("__channel", "l")).select("recording_id", F.col("__channel").cast("int").alias("__channel"), F.posexplode("l").alias("__p", "c"))
    order = Window.partitionBy("recording_id").orderBy(F.coalesce("c.wall_time", F.lit(0.0)), "__channel", "__p")
    mapped = mapped.withColumn("__at", F.row_number().over(order) - 1).drop("__p")
    both = listed.unionByName(mapped)
    return both.select("recording_id", F.coalesce("c.channel_id", "__channel").alias("channel_id"), F.col("__at").alias("position"), F.coalesce("c.overlap", F.lit(0.0)).alias("overlap"), F.coalesce("c.is_final", F.lit(False)).alias("is_final"), F.col("c.wall_time").alias("wall_time"), "c.n_samples")


def newest_first(df: DataFrame, time: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(time), *[F.col(c) for c in df.columns[:1]])
    return out.limit(n) if n is not None else out


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of the same key; the caller writes the result as a new snapshot."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_by_key(parent: DataFrame, children: DataFrame, keys: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    gone = keys.select(F.col(key).alias("__gone")).distinct()
    return parent.join(gone, F.col(key) == F.col("__gone"), "left_anti"), children.join(gone, F.col(foreign) == F.col("__gone"), "left_anti")


def retain_latest_n(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The n most recent rows: a top-k, no global sort."""
    return df.orderBy(F.desc(time), key).limit(n)


def retain_with_children(parent: DataFrame, children: dict[str, DataFrame], time: str, key: str, foreign: str, n: int) -> tuple[DataFrame, dict[str, DataFrame], int]:
    """The n most recent rows, the children that belong to them, and how many rows go.

    Children hang on the kept keys, of which there are n at most.
    """
    kept = retain_latest_n(parent, time, key, n)
    keys = F.broadcast(kept.select(F.col(key).alias("__kept")))
    left = {name: c.join(keys, F.col(foreign) == F.col("__kept"), "left_semi") for name, c in children.items()}
    return kept, left, max(0, parent.count() - n)


def list_recordings(recordings: DataFrame) -> DataFrame:
    """Metadata only; the reader never touches audio columns."""
    return newest_first(recordings.select("id", "status", "created_at", "duration"), "created_at")


def read_session_logs(logs: DataFrame, session: Column | None = None, kind: str | None = None) -> DataFrame:
    """Logs by session and time; filters reach the partitions (session_id, type)."""
    rows = logs if session is None else logs.where(F.col("session_id") == session)
    return (rows if kind is None else rows.where(F.col("type") == kind)).orderBy("session_id", "ts", "log_id")


def log_rows(events: DataFrame, kind: str, payload: list[str], verbose: bool = False, cut: int = 100) -> DataFrame:
    """Typed log rows; texts are cut unless verbose."""
    short = lambda c: F.col(c) if verbose or events.schema[c].dataType != T.StringType() else F.substring(c, 1, cut).alias(c)
    return events.select("session_id", "ts", F.lit(kind).alias("type"), F.to_json(F.struct(*[short(c) for c in payload])).alias("data"))


def append_log(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").partitionBy("session_id", "type").parquet(path)


def export_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One text a recording: `Label [M:SS - M:SS]: text`, environmental rows without a label."""
    times = F.concat(F.lit("["), format_time(F.col("start")), F.lit(" - "), format_time(F.col("end")), F.lit("]"))
    line = F.when(F.col("is_environmental"), F.concat(times, F.lit(": "), F.col("text"))).otherwise(F.concat(F.col("label"), F.lit(" "), times, F.lit(": "), F.col("text")))
    rows = segments.select(*keys, "segment_index", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "line"))), lambda s: s["line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("text"))


def export_job_json(jobs: DataFrame, segments: DataFrame, key: str = "job_id") -> DataFrame:
    """One JSON document a job: header, counts and segments in order."""
    listed = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment_index", "speaker_label", "effective_speaker", "was_influenced"))).alias("segments"))
    rows = jobs.join(listed, key, "left")
    stats = F.struct(F.size("segments").alias("n_segments"), F.size(F.filter("segments", lambda s: s["was_influenced"])).alias("n_changed"))
    return rows.select(key, F.to_json(F.struct(F.struct(*[c for c in jobs.columns]).alias("job"), stats.alias("stats"), "segments")).alias("json"))


def export_job_document(jobs: DataFrame, recordings: DataFrame, enrollments: DataFrame, segments: DataFrame) -> DataFrame:
    """(job_id, json): the whole export of each job.

    jobs: job_id, recording_id and more columns; recordings: recording_id and more; enrollments: job_id, name and more;
    segments: job_id, segment_index, speaker_label, effective_speaker, similarity, candidates, display_label, boosted,
    was_influenced and more. The document has the job's and the recording's header, the enrollments by name, counts,
    the participants by share of segments, and the segments in order with their ranked candidates, attribution and boosting.
    """
    ranked = F.transform("candidates", lambda c, i: F.struct((i + 1).alias("rank"), c["name"].alias("name"), F.round(c["similarity"], 6).alias("similarity")))
    attribution = F.struct("speaker_label", F.round("similarity", 6).alias("similarity"), "display_label")
    boosting = F.struct("boosted", "was_influenced")
    known = {"job_id", "segment_index", "speaker_label", "effective_speaker", "similarity", "candidates", "display_label", "boosted", "was_influenced"}
    extra = [c for c in segments.columns if c not in known]
    one = F.struct("segment_index", *extra, "effective_speaker", ranked.alias("candidates"), attribution.alias("attribution"), boosting.alias("boosting"))
    listed = segments.groupBy("job_id").agg(
        F.array_sort(F.collect_list(one)).alias("segments"), F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("boosted")).alias("n_boosted"), F.count_if(F.col("was_influenced")).alias("n_changed")
    )
    shares = segments.where(F.col("effective_speaker").isNotNull()).groupBy("job_id", "effective_speaker").agg(F.count(F.lit(1)).alias("n"))
    people = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("effective_speaker").alias("name")))), lambda p: F.struct(p["name"].alias("name"), (-p["m"]).alias("n_segments")))
    participants = shares.groupBy("job_id").agg(people.alias("participants"))
    enrolled = enrollments.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("name", *[c for c in enrollments.columns if c not in ("job_id", "name")]))).alias("enrollments"))
    heads = recordings.select("recording_id", F.struct("recording_id", *[c for c in recordings.columns if c != "recording_id"]).alias("recording"))
    rows = jobs.select("job_id", "recording_id", F.struct(*jobs.columns).alias("job")).join(heads, "recording_id", "left")
    for part in (enrolled, listed, participants):
        rows = rows.join(part, "job_id", "left")
    stats = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_segments", "n_boosted", "n_changed")], F.coalesce(F.size("participants"), F.lit(0)).alias("n_participants"))
    document = F.struct("job", "recording", F.coalesce("enrollments", F.array()).alias("enrollments"), stats.alias("stats"), F.coalesce("participants", F.array()).alias("participants"), F.coalesce("segments", F.array()).alias("segments"))
    return rows.select("job_id", F.to_json(document).alias("json"))


def export_raw_chunks(chunks: DataFrame) -> DataFrame:
    """(recording_id, chunk_index, json): each chunk's words as transcribed, its overlap and how it was merged."""
    merge = F.struct("merge_index", F.round("merge_confidence", 6).alias("merge_confidence"), "method", F.round("merge_time", 6).alias("merge_time"))
    return chunks.select("recording_id", "chunk_index", F.to_json(F.struct("chunk_index", F.struct(F.col("words").alias("all_words")).alias("raw_asr"), "overlap", merge.alias("merge_info"))).alias("json"))


def export_transcript_json(segments: DataFrame) -> DataFrame:
    """(recording_id, segment_index, json): a line for each segment, so that no row holds a whole recording."""
    return segments.select("recording_id", "segment_index", F.to_json(F.struct(*[c for c in segments.columns if c != "recording_id"])).alias("json"))


def migrate_v1_to_v2(recordings: DataFrame) -> DataFrame:
    """Version-1 rows get their result as a first processed job."""
    old = F.coalesce("schema_version", F.lit(1)) < 2
    job = F.struct(F.concat(F.col("id").cast("string"), F.lit("-job-1")).alias("id"), F.lit("Original Processing").alias("name"), F.lit("processed").alias("status"), F.coalesce("model_id", F.lit("default")).alias("model_id"), F.col("participants").alias("participants"))
    jobs = F.when(old, F.array(job)).otherwise(F.col("jobs")) if "jobs" in recordings.columns else F.when(old, F.array(job))
    return recordings.withColumns({"jobs": jobs, "active_job_id": F.when(old, job["id"]).otherwise(F.col("active_job_id")), "schema_version": F.lit(2)})


def active_job(recordings: DataFrame, jobs: DataFrame) -> DataFrame:
    return recordings.join(jobs, (F.col("active_job_id") == F.col("job_id")) & (F.col("id") == F.col("recording_id")))


def recording_with_chunks(recordings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each recording with its chunk indices in order, an empty array without any."""
    listed = chunks.groupBy("recording_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("chunks"))
    return recordings.join(listed, F.col("id") == F.col("recording_id"), "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<int>"))).drop("recording_id")


def channel_config(segments: DataFrame, channels: DataFrame) -> DataFrame:
    """Labels and expected speakers of channels; `Input n` and 2 by default."""
    rows = segments.join(channels, ["recording_id", "channel_id"], "left")
    return rows.withColumns({"channel_label": F.coalesce("channel_label", F.concat(F.lit("Input "), (F.col("channel_id") + 1).cast("string"))), "expected_speakers": F.coalesce("expected_speakers", F.lit(2))})


def global_segment_index(segments: DataFrame, keys: list[str]) -> DataFrame:
    """By chunk, then start, speech before environmental sounds, then position."""
    order = Window.partitionBy(*keys).orderBy("chunk_seq", "start", "kind", "pos")
    return segments.withColumn("segment_index", F.row_number().over(order) - 1)


def chunk_order(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.withColumn("processing_order", F.row_number().over(Window.partitionBy(*keys).orderBy("wall_time", "channel_id", "chunk_index")) - 1)


def storage_size(samples: Column, segment_bytes: Column, asr_bytes: Column) -> Column:
    return F.round(1.2 * (segment_bytes + 4 * samples + asr_bytes)).cast("long")


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_logs"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


def stage_timings(logs: DataFrame) -> DataFrame:
    return logs.groupBy("session_id", "type").agg(F.sum("value").alias("total_ms"), F.avg("value").alias("mean_ms"), F.max("value").alias("max_ms"))


def validate_job_settings(jobs: DataFrame, fields: list[str]) -> DataFrame:
    """All fields there, and the model's id and name not empty."""
    there = F.lit(True)
    for f in fields:
        there = there & F.col(f"settings.{f}").isNotNull()
    named = (F.coalesce("settings.model.id", F.lit("")) != "") & (F.coalesce("settings.model.name", F.lit("")) != "")
    return jobs.withColumn("is_valid", there & named)


def save_session(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """The recording row of each session with chunks and segments: duration, participants, counts."""
    seg = segments.groupBy("recording_id").agg(F.max_by("end", "segment_index").alias("duration"), F.count(F.lit(1)).alias("n_segments"), F.countDistinct("speaker").alias("n_participants"))
    return seg.join(chunks.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_chunks")), "recording_id")


def session_tables(sessions: DataFrame, segments: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What saving sessions writes: recordings, jobs, segments and chunks.

    sessions: recording_id, model_id; segments: recording_id, segment_index, start, end, speaker; chunks: recording_id,
    chunk_index, n_samples. A session without chunks or without segments is skipped. A recording's duration is its last
    segment's end; its size counts four bytes a sample.
    """
    seg = segments.groupBy("recording_id").agg(F.max_by("end", "segment_index").alias("duration"), F.count(F.lit(1)).alias("n_segments"), F.sort_array(F.collect_set("speaker")).alias("participants"))
    chk = chunks.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_samples").alias("__samples"))
    rows = sessions.join(seg, "recording_id").join(chk, "recording_id")
    job = F.concat(F.col("recording_id").cast("string"), F.lit("-job-1")).alias("job_id")
    size = storage_size(F.col("__samples"), F.lit(0), F.lit(0)).alias("size")
    kept = rows.select(F.col("recording_id").alias("__kept"))
    semi = lambda df: df.join(kept, F.col("recording_id") == F.col("__kept"), "left_semi")
    return {
        "recordings": rows.select("recording_id", "duration", "n_segments", "n_chunks", F.size("participants").cast("long").alias("n_participants"), size, job.alias("active_job_id")),
        "jobs": rows.select("recording_id", job, F.lit("Original Processing").alias("name"), F.lit("processed").alias("status"), "model_id", "participants"),
        "segments": semi(segments.select("recording_id", "segment_index", "start", "end", "speaker")),
        "chunks": semi(chunks.select("recording_id", "chunk_index", "n_samples")),
    }


SESSION_TABLES = {
    "recordings": Table("recording_id long, duration double, n_segments long, n_chunks long, n_participants long, size long, active_job_id string", ("recording_id",)),
    "jobs": Table("recording_id long, job_id string, name string, status string, model_id string, participants array<string>", ("recording_id", "job_id")),
    "segments": Table("recording_id long, segment_index long, start double, end double, speaker string", ("recording_id", "segment_index")),
    "chunks": Table("recording_id long, chunk_index long, n_samples long", ("recording_id", "chunk_index")),
}


def save_sessions(store: Store, version: int, sessions: DataFrame, segments: DataFrame, chunks: DataFrame) -> None:
    """Publishes the four tables of the sessions together; again with the same version, as a retried foreachBatch does, it changes nothing."""
    store.publish(version, session_tables(sessions, segments, chunks))
