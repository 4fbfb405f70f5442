"""Words to phrases and segments: gaps and islands, interval joins, run merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions import text as X
from voxspark.functions import vectors as V


def detect_phrases(words: DataFrame, keys: list[str], gap: float = 0.2) -> DataFrame:
    """A phrase ends where the next word starts `gap` or more after the last kept word's end. Words without times are dropped."""
    order = Window.partitionBy(*keys).orderBy("pos")
    timed = words.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    new = F.when(F.col("start") - F.lag("end").over(order) >= gap, 1).otherwise(0)
    marked = timed.withColumn("__new", new).withColumn("phrase_id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words_of = F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end")))
    out = marked.groupBy(*keys, "phrase_id").agg(words_of.alias("words"))
    return out.withColumns({"start": F.element_at("words", 1)["start"], "end": F.element_at("words", -1)["end"], "n_words": F.size("words")})


def phrases_of(words: Column, gap: float = 0.2) -> Column:
    """detect_phrases of one array of words, as an array of (phrase_id, words, start, end, n_words)."""
    timed = F.array_sort(F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull()))

    def split(ws: Column) -> Column:
        begins = lambda w, i: (i == 0) | (w["start"] - F.get(ws, i - 1)["end"] >= gap)
        firsts = F.filter(F.transform(ws, lambda w, i: F.when(begins(w, i), i)), lambda i: i.isNotNull())

        def phrase(first: Column, k: Column, all_firsts: Column) -> Column:
            part = F.slice(ws, first + 1, F.coalesce(F.get(all_firsts, k + 1), F.size(ws)) - first)
            return F.struct(k.cast("long").alias("phrase_id"), part.alias("words"), F.element_at(part, 1)["start"].alias("start"), F.element_at(part, -1)["end"].alias("end"), F.size(part).alias("n_words"))

        return V.let(firsts, lambda fs: F.transform(fs, lambda f, k: phrase(f, k, fs)))

    return V.let(timed, split)


def join_text(words: Column, separator: str = "") -> Column:
    return X.trim(F.array_join(F.transform(words, lambda w: w["text"]), separator))


def map_words_to_segments(words: DataFrame, segments: DataFrame, keys: list[str], bucket: float = 15.0) -> DataFrame:
    """Speaker of the first segment, by (start, seg_id), that holds a word's middle; none gives null and 0.

    An interval join: segments go to every time bucket they touch, words to one, so it is an equality
    join on keys and bucket.
    """
    at = F.col("__mid")
    w = words.withColumn("__mid", (F.col("start") + F.col("end")) / 2).withColumn("__bucket", F.floor(at / bucket))
    spans = segments.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("seg_id").alias("__id"), F.col("speaker").alias("__speaker"), F.col("confidence").alias("__confidence"))
    spans = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__s") / bucket), F.floor(F.col("__e") / bucket))))
    hit = (w["__bucket"] == spans["__bucket"]) & (spans["__s"] <= w["__mid"]) & (w["__mid"] < spans["__e"])
    for k in keys:
        hit &= w[k].eqNullSafe(spans[k])
    joined = w.join(spans, hit, "left").select(*[w[c] for c in words.columns], "__s", "__id", "__speaker", "__confidence")
    first = F.min(F.struct(F.col("__s").isNull(), "__s", "__id", "__speaker", "__confidence")).alias("__first")
    found = joined.groupBy(*words.columns).agg(first)
    confidence = F.when(F.col("__first.__s").isNull(), 0.0).otherwise(F.coalesce(F.nullif(F.col("__first.__confidence"), F.lit(0.0)), F.lit(1.0)))
    return found.select(*words.columns, F.col("__first.__speaker").alias("speaker"), confidence.alias("confidence"))


def group_by_speaker_run(words: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive words of one speaker, null being a speaker too; words without times don't break a run."""
    order = Window.partitionBy(*keys).orderBy("pos")
    timed = words.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    new = F.when((F.row_number().over(order) > 1) & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)), 1).otherwise(0)
    runs = timed.withColumn("__new", new).withColumn("phrase_id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "phrase_id").agg(
        F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.min_by("speaker", "pos").alias("speaker"), F.count(F.lit(1)).alias("n_words"), F.avg("confidence").alias("avg_confidence")
    )


def absorb_short_phrases(phrases: DataFrame, keys: list[str], minimum: float = 0.5) -> DataFrame:
    """Phrases under the minimum go to the phrase before; the speaker switches when the absorbed one has more words than all before it."""
    order = Window.partitionBy(*keys).orderBy("phrase_id")
    head = F.when((F.row_number().over(order) == 1) | (F.col("end") - F.col("start") >= minimum), 1).otherwise(0)
    marked = phrases.withColumn("__head", head).withColumn("__island", F.sum("__head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "__island").orderBy("phrase_id").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("n_words") > F.coalesce(F.sum("n_words").over(inside), F.lit(0))
    marked = marked.withColumn("__wins", F.when(wins, F.col("phrase_id")))
    return marked.groupBy(*keys, "__island").agg(
        F.min("phrase_id").alias("phrase_id"), F.min_by("start", "phrase_id").alias("start"), F.max_by("end", "phrase_id").alias("end"), F.max_by("speaker", "__wins").alias("speaker"),
        F.sum("n_words").alias("n_words"), F.min_by("avg_confidence", "phrase_id").alias("avg_confidence"),
    ).drop("__island")


def merge_same_speaker(segments: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """Neighbours by (start, seg_id) of one speaker at most `gap` apart become one; confidences average pairwise. 0 turns it off."""
    if gap == 0:
        return segments.select(*keys, "start", "end", "speaker", "confidence", F.lit(1).cast("long").alias("n"))
    order = Window.partitionBy(*keys).orderBy("start", "seg_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.withColumn("__run", F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__run").over(so_far))
    in_run = Window.partitionBy(*keys, "__run").orderBy("start", "seg_id")
    apart = F.col("start") - F.max("end").over(in_run.rowsBetween(Window.unboundedPreceding, -1)) > gap
    rows = rows.withColumn("__island", F.sum(F.when(apart, 1).otherwise(0)).over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*keys, "__run", "__island").orderBy("start", "seg_id")
    rows = rows.withColumns({"__i": F.row_number().over(island), "__n": F.count(F.lit(1)).over(island.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # members i = 1..n: c1 * 2^-(n-1) + sum of ci * 2^-(n-i+1)
    weight = F.pow(F.lit(2.0), -F.when(F.col("__i") == 1, F.col("__n") - 1).otherwise(F.col("__n") - F.col("__i") + 1))
    return rows.groupBy(*keys, "__run", "__island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"), F.sum(F.col("confidence") * weight).alias("confidence"), F.count(F.lit(1)).alias("n")
    ).drop("__run", "__island")


def filter_segments(segments: DataFrame, min_confidence: float = 0.0, min_duration: float = 0.0) -> DataFrame:
    if min_confidence > 0:
        segments = segments.where(F.col("confidence") >= min_confidence)
    return segments.where(F.col("end") - F.col("start") >= min_duration) if min_duration > 0 else segments


def pad_segments(segments: DataFrame, pad: float, duration: Column) -> DataFrame:
    return segments.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - pad), "end": F.least(duration, F.col("end") + pad)})


def adjust_timestamps(words: DataFrame, overlap: Column) -> DataFrame:
    """Both ends less the overlap, not below 0; missing times stay missing."""
    back = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c) - overlap))
    return words.withColumns({"start": back("start"), "end": back("end")})


def drop_unusable(phrases: DataFrame) -> DataFrame:
    """Phrases with a word that is no blank marker, of some length, and not without embedding and inherited."""
    filled = F.exists("words", lambda w: X.strip_blank_markers(w["text"]) != "")
    inherited = F.col("embedding").isNull() & (F.coalesce(F.col("reason"), F.lit("")) == "inherited")
    return phrases.where(filled & (F.col("end") > F.col("start")) & ~inherited)


def embedding_gate(phrases: DataFrame, expected_speakers: Column, min_duration: float = 0.5, min_samples: int = 8000, rate: int = 16_000) -> DataFrame:
    """Why a phrase gets no embedding; null if it gets one."""
    length = F.ceil(F.col("end") * rate) - F.floor(F.col("start") * rate)
    reason = F.when(expected_speakers == 1, "skipped_single_speaker").when((F.col("end") - F.col("start") < min_duration) | (length < min_samples), "too_short")
    return phrases.withColumn("reason", reason)


#: Frames in a row of `frame_sums`.
FRAME_BUCKET = 256


def frame_sums(frames: DataFrame, keys: list[str], size: int = FRAME_BUCKET) -> DataFrame:
    """Prefix sums by bucket of frames: keys, bucket, frames (of the bucket, in order), before (sum of all frames of earlier buckets).

    frames: keys, frame (from 0 without gaps), feat. No row holds more than `size` frames.
    """
    rows = frames.withColumn("__bucket", F.floor(F.col("frame") / size)).groupBy(*keys, "__bucket")
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "feat"))), lambda s: V.doubles(s["feat"])).alias("__frames"))
    long = rows.select(*keys, "__bucket", F.posexplode(added(F.col("__frames"), F.col("__frames"))).alias("__dim", "__sum"))
    earlier = Window.partitionBy(*keys, "__dim").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("__sum", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)))
    before = long.groupBy(*keys, "__bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("__dim", "__sum"))), lambda s: s["__sum"]).alias("__before"))
    return rows.join(before, [*keys, "__bucket"])


def added(vectors: Column, like: Column) -> Column:
    """Sum of an array of vectors, each as long as the first of `like`."""
    zero = F.transform(F.element_at(like, 1), lambda _: F.lit(0.0))
    return F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def pool_frames(phrases: DataFrame, frames: DataFrame, keys: list[str], duration: float | Column, min_duration: float = 0.5) -> DataFrame:
    """Mean of the frames of each phrase. frames: keys, frame, feat; the clip's frame rate is its frames by its duration.

    A phrase's sum is the difference of the prefix sums at its two ends, each from the one bucket it falls into.
    """
    length = duration if isinstance(duration, Column) else F.lit(float(duration))
    clip = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    rows = phrases.join(clip, keys, "left").withColumn("__rate", F.coalesce("n_frames", F.lit(0)) / length)
    low = F.floor(F.col("start") * F.col("__rate"))
    high = F.least(F.ceil(F.col("end") * F.col("__rate")), F.coalesce("n_frames", F.lit(0)))
    rows = rows.withColumns({"__low": low, "__high": high, "frame_count": F.greatest(F.lit(0), high - low)})
    reason = F.when(F.col("end") - F.col("start") < min_duration, "too_short").when(F.col("frame_count") <= 0, "no_frames")
    rows = rows.withColumn("reason", reason)
    sums = frame_sums(frames, keys)
    for end, last in (("__low", F.col("__low")), ("__high", F.col("__high") - 1)):
        side = sums.select(*keys, F.col("__bucket").alias(f"{end}_b"), F.col("__frames").alias(f"{end}_f"), F.col("__before").alias(f"{end}_s"))
        rows = rows.withColumn(f"{end}_b", F.when(F.col("reason").isNull(), F.floor(last / FRAME_BUCKET))).join(side, [*keys, f"{end}_b"], "left")
        inside = F.slice(f"{end}_f", F.lit(1), (F.col(end) - F.col(f"{end}_b") * FRAME_BUCKET).cast("int"))
        rows = rows.withColumn(f"{end}_sum", F.zip_with(f"{end}_s", added(inside, F.col(f"{end}_f")), lambda a, b: a + b)).drop(f"{end}_f", f"{end}_s", f"{end}_b")
    mean = F.zip_with("__high_sum", "__low_sum", lambda a, b: (a - b) / F.col("frame_count"))
    out = rows.withColumn("embedding", F.when(F.col("reason").isNull(), mean))
    return out.select(*phrases.columns, "frame_count", "reason", "embedding")


def decode_frames(logits: DataFrame, clip: str, duration: Column | None = None, step: int = 270, offset: int = 990, rate: int = 16_000) -> DataFrame:
    """Runs of each speaker over the frames' most likely classes.

    A run starts at its first frame's time and ends at that of the first frame without the speaker,
    or at the clip's duration (the time after its last frame if none is given).
    """
    time = lambda f: (offset + step * f) / rate
    probabilities = V.softmax(F.col("logits"))
    top = logits.select(clip, "frame", V.argmax(F.col("logits")).alias("__class"), F.array_max(probabilities).alias("__p"))
    last = Window.partitionBy(clip)
    top = top.withColumn("__last", F.max("frame").over(last))
    active = top.select(clip, "frame", "__p", "__last", F.explode(V.powerset_speakers(F.col("__class"))).alias("speaker"))
    order = Window.partitionBy(clip, "speaker").orderBy("frame")
    runs = active.withColumn("__run", F.col("frame") - F.row_number().over(order)).groupBy(clip, "speaker", "__run", "__last")
    runs = runs.agg(F.min("frame").alias("__first"), F.max("frame").alias("__end"), F.avg("__p").alias("confidence"))
    closing = F.when(F.col("__end") == F.col("__last"), duration if duration is not None else time(F.col("__end") + 1)).otherwise(time(F.col("__end") + 1))
    return runs.select(clip, "speaker", time(F.col("__first")).alias("start"), closing.alias("end"), "confidence")
