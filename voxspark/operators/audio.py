"""Samples of recordings kept as arrays by chunk: joining, slicing, checks and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions import vectors as V


def chunk_offsets(chunks: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """Where each chunk's samples begin in the recording."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumns({"n_samples": F.size("audio"), "first_sample": F.coalesce(F.sum(F.size("audio")).over(before), F.lit(0))})


def combine_chunks(chunks: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """All samples of a recording in order, as one array; recordings that are too long for a row stay chunks with offsets."""
    parts = F.array_sort(F.collect_list(F.struct(order, "audio")))
    return chunks.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["audio"])).alias("audio"))


def slice_audio(segments: DataFrame, audio: DataFrame, keys: list[str], rate: int = 16_000, strict: bool = False) -> DataFrame:
    """Samples floor(start * rate) up to ceil(end * rate) of each segment; strict drops empty ranges and those beyond the end."""
    rows = segments.join(audio, keys).withColumns({"__a": F.floor(F.col("start") * rate), "__b": F.ceil(F.col("end") * rate)})
    if strict:
        rows = rows.where((F.col("__b") > F.col("__a")) & (F.col("__b") <= F.size("audio")))
    length = F.greatest(F.lit(0), F.least(F.col("__b"), F.size("audio")) - F.col("__a")).cast("int")
    return rows.withColumn("audio", F.slice("audio", (F.col("__a") + 1).cast("int"), length)).drop("__a", "__b")


def slice_chunks(segments: DataFrame, chunks: DataFrame, keys: list[str], order: str = "chunk_index", rate: int = 16_000, strict: bool = False, bucket: int = 1 << 18) -> DataFrame:
    """slice_audio from a recording's chunks, of which only those that a segment touches meet it.

    An overlap join: segments and chunks go to every bucket of samples they touch and meet in equal buckets; a pair
    counts in the first bucket both have. The touched parts are put together in order, so no row holds more
    than a segment. Offsets come from the chunks' lengths alone. Repeated rows of segments count once.
    """
    sizes = chunks.select(*keys, order, F.size("audio").cast("long").alias("__n"))
    by = Window.partitionBy(*keys)
    before = F.sum("__n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"__first": F.coalesce(before, F.lit(0)), "__total": F.sum("__n").over(by)})
    totals = sizes.groupBy(*keys).agg(F.max("__total").alias("__size"))
    spans = chunks.select(*keys, order, "audio").join(sizes, [*keys, order]).where("__n > 0")
    across = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
    spans = spans.select(*keys, "__first", (F.col("__first") + F.col("__n")).alias("__last"), F.col("audio").alias("__audio")).withColumn("__bucket", across("__first", "__last"))
    rows = segments.distinct().join(totals, keys)
    rows = rows.withColumns({"__a": F.floor(F.col("start") * rate), "__b": F.ceil(F.col("end") * rate)})
    if strict:
        rows = rows.where((F.col("__b") > F.col("__a")) & (F.col("__b") <= F.col("__size")))
    rows = rows.withColumn("__b", F.least("__b", "__size"))
    asked = rows.where("__b > __a").withColumn("__bucket", across("__a", "__b"))
    own = asked.join(spans, [*keys, "__bucket"]).where((F.col("__first") < F.col("__b")) & (F.col("__a") < F.col("__last")))
    own = own.where(F.col("__bucket") == F.greatest(F.floor(F.col("__a") / bucket), F.floor(F.col("__first") / bucket)))
    start = F.greatest("__a", "__first")
    part = F.slice("__audio", (start - F.col("__first") + 1).cast("int"), (F.least("__b", "__last") - start).cast("int"))
    parts = own.select(*segments.columns, F.struct(start.alias("at"), part.alias("part")).alias("__part")).groupBy(*segments.columns)
    found = parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list("__part")), lambda p: p["part"])).alias("audio"))
    if strict:
        return found
    nothing = rows.where("__b <= __a").select(*segments.columns).withColumn("audio", F.array().cast(chunks.schema["audio"].dataType))
    return found.unionByName(nothing)


def clipping_ratio(audio: Column, limit: float = 0.99) -> Column:
    return F.when(F.size(audio) > 0, F.size(F.filter(audio, lambda x: F.abs(x) >= limit)) / F.size(audio)).otherwise(0.0)


def rms(audio: Column) -> Column:
    v = V.doubles(audio)
    return F.when(F.size(v) > 0, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v))).otherwise(0.0)


def rms_status(level: Column, low: float = 0.01, high: float = 0.5) -> Column:
    return F.when(level < low, "too_quiet").when(level > high, "too_loud").otherwise("ok")


def speech_content(samples: DataFrame, keys: list[str], rate: int = 16_000, frame: int = 512, threshold: float = 0.02) -> DataFrame:
    """Seconds of whole frames whose RMS is over the threshold. samples: keys, i (from 0), x."""
    frames = samples.groupBy(*keys, F.floor(F.col("i") / frame).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"))
    out = frames.groupBy(*keys).agg((F.count_if((F.col("n") == frame) & (F.col("level") > threshold)) * frame / rate).alias("speech_seconds"), (F.sum("n") / rate).alias("total_seconds"))
    return out.withColumn("speech_ratio", F.when(F.col("total_seconds") > 0, F.col("speech_seconds") / F.col("total_seconds")).otherwise(0.0))


def validate_enrollment_audio(rows: DataFrame, min_seconds: float = 5.0, min_ratio: float = 0.5, max_clipping: float = 0.001) -> DataFrame:
    """Errors and warnings from clipping_ratio, rms_status, speech_seconds and speech_ratio."""
    errors = F.array_compact(F.array(F.when(F.col("rms_status") != "ok", F.col("rms_status")), F.when(F.col("speech_seconds") < min_seconds, "too_little_speech"), F.when(F.col("speech_ratio") < min_ratio, "low_speech_ratio")))
    warnings = F.array_compact(F.array(F.when(F.col("clipping_ratio") > max_clipping, "clipping")))
    return rows.withColumns({"errors": errors, "warnings": warnings}).withColumn("passed", F.size("errors") == 0)


def peak_normalize(audio: Column, peak: float = 0.95, least: float = 0.001) -> Column:
    v = V.doubles(audio)
    return V.let(F.array_max(F.transform(v, F.abs)), lambda m: F.when(m > least, F.transform(v, lambda x: x * peak / m)).otherwise(v))


def feature_mean_var_norm(frames: DataFrame, clip: str, feat: str = "feat") -> DataFrame:
    """(clip, frame, bin, value): each bin of a clip to mean 0 and variance 1."""
    long = frames.select(clip, "frame", F.posexplode(feat).alias("bin", "x"))
    w = Window.partitionBy(clip, "bin")
    mean, square = F.avg("x").over(w), F.avg(F.col("x") * F.col("x")).over(w)
    return long.withColumns({"__m": mean, "__s": square}).select(clip, "frame", "bin", ((F.col("x") - F.col("__m")) / F.sqrt(F.greatest(F.col("__s") - F.col("__m") * F.col("__m"), F.lit(1e-10)))).alias("value"))


def fixed_chunks(recordings: DataFrame, seconds: float = 10.0, overlap: float = 1.5, duration: str = "duration") -> DataFrame:
    """Tumbling chunks, each with the overlap before it."""
    n = F.greatest(F.ceil(F.col(duration) / seconds).cast("int"), F.lit(1))
    rows = recordings.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    first = F.col("chunk_index") * seconds
    return rows.withColumns({"start": F.greatest(F.lit(0.0), first - overlap), "end": F.least(F.col(duration), first + seconds), "overlap": F.least(F.lit(float(overlap)), first)})


def split_long_segments(segments: DataFrame, keys: list[str], longest: float = 15.0, overlap: float = 1.5, shortest: float = 0.3) -> DataFrame:
    """Segments over 1.1 times the longest length in pieces of it; a piece after a forced cut begins with the overlap before it."""
    length = F.col("end") - F.col("start")
    n = F.when(length > 1.1 * longest, F.ceil(length / longest)).otherwise(1).cast("int")
    rows = segments.withColumn("__n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    begin = F.col("start") + F.col("piece") * longest
    stop = F.when(F.col("piece") == F.col("__n") - 1, F.col("end")).otherwise(begin + longest)
    forced = F.when(F.col("piece") > 0, overlap).otherwise(0.0)
    out = rows.withColumns({"__b": begin, "__e": stop, "overlap": forced})
    out = out.where(F.col("__e") - F.col("__b") >= shortest)
    return out.select(*keys, "piece", (F.col("__b") - F.col("overlap")).alias("start"), F.col("__e").alias("end"), "overlap", (F.col("piece") < F.col("__n") - 1).alias("forced"))


def speech_segments(frames: DataFrame, keys: list[str], step: float, open_at: float = 0.5, close_at: float = 0.35, hold: float = 0.3, pad: float = 0.15, shortest: float = 0.3) -> DataFrame:
    """Hysteresis on frame probabilities (frame, p): open at `open_at`, close after `hold` seconds under `close_at`.

    A frame under close_at ends speech when it is the last of enough of them since the last louder one;
    the state is then the latest of the opening and closing events, so windows suffice.
    """
    order = Window.partitionBy(*keys).orderBy("frame")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    need = max(1, round(hold / step))
    rows = frames.withColumn("__loud", F.coalesce(F.max(F.when(F.col("p") >= close_at, F.col("frame"))).over(so_far), F.lit(-1)))
    event = F.when(F.col("p") >= open_at, 1).when(F.col("frame") - F.col("__loud") >= need, 0)
    rows = rows.withColumn("__state", F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(0)))
    rows = rows.withColumn("__new", F.when((F.col("__state") == 1) & (F.coalesce(F.lag("__state").over(order), F.lit(0)) == 0), 1).otherwise(0))
    rows = rows.withColumn("segment_index", F.sum("__new").over(so_far) - 1).where("__state = 1")
    spans = rows.groupBy(*keys, "segment_index").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    spans = spans.withColumns({"start": F.greatest(F.lit(0.0), F.col("a") * step - pad), "end": (F.col("b") + 1) * step})
    return spans.where((F.col("b") + 1 - F.col("a")) * step >= shortest).drop("a", "b")
