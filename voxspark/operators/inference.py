"""Who takes part in a conversation, from all its segments, and what follows for each segment."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.config import Inference
from voxspark.operators.speakers import margin, nth

SEGMENT = ["recording_id", "segment_index"]


def assignment_stats(segments: DataFrame) -> DataFrame:
    """For each label of a recording: how often, mean similarity (0.5 without any), first place, whether unknown."""
    return segments.where(F.col("speaker_label").isNotNull()).groupBy("recording_id", F.col("speaker_label").alias("speaker_name")).agg(
        F.count(F.lit(1)).alias("segment_count"), F.coalesce(F.avg("similarity"), F.lit(0.5)).alias("avg_similarity"), F.min("segment_index").alias("first_index")
    ).withColumn("is_unknown", F.col("speaker_name").startswith("Unknown"))


def competitive_points(segments: DataFrame, rank: int = 2) -> DataFrame:
    """One row for each of a segment's first `rank` candidates."""
    top = segments.select(*SEGMENT, F.posexplode(F.slice("candidates", 1, rank)).alias("p", "c"))
    return top.select(*SEGMENT, F.col("c.name").alias("speaker_name"), F.col("c.similarity").alias("similarity"), (F.col("p") + 1).alias("rank"))


def competitive_stats(segments: DataFrame, rank: int = 2) -> DataFrame:
    return competitive_points(segments, rank).groupBy("recording_id", "speaker_name").agg(
        F.count(F.lit(1)).alias("competitive_count"), F.count_if(F.col("rank") == 1).alias("best_count"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"), F.avg("similarity").alias("avg_similarity")
    )


def similarity_trend(points: DataFrame) -> DataFrame:
    """Mean of the second half less that of the first, from four points on: improving, declining or stable."""
    by = Window.partitionBy("recording_id", "speaker_name")
    rows = points.withColumns({"__i": F.row_number().over(by.orderBy("segment_index")), "__n": F.count(F.lit(1)).over(by)})
    first = F.col("__i") <= F.floor(F.col("__n") / 2)
    means = rows.groupBy("recording_id", "speaker_name").agg(F.max("__n").alias("n"), (F.avg(F.when(~first, F.col("similarity"))) - F.avg(F.when(first, F.col("similarity")))).alias("change"))
    trend = F.when((F.col("n") >= 4) & (F.col("change") > 0.05), "improving").when((F.col("n") >= 4) & (F.col("change") < -0.05), "declining").otherwise("stable")
    return means.select("recording_id", "speaker_name", trend.alias("trend"))


def speaker_summary(segments: DataFrame) -> DataFrame:
    stats = competitive_stats(segments).withColumn("runner_up_count", F.col("competitive_count") - F.col("best_count"))
    return stats.join(similarity_trend(competitive_points(segments)), ["recording_id", "speaker_name"])


def recent_points(segments: DataFrame, n: int = 20) -> DataFrame:
    last = Window.partitionBy("recording_id", "speaker_name").orderBy(F.desc("segment_index"))
    return competitive_points(segments).withColumn("__i", F.row_number().over(last)).where(F.col("__i") <= n).drop("__i")


def unknown_confidence(count: Column, minimum: int = 2) -> Column:
    """Of an unknown cluster as a participant; null under the minimum."""
    return F.when(count >= minimum, F.least(F.lit(0.9), 0.5 + 0.05 * count))


def closest_enrolled(history: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Most frequent nearest enrolled name of a cluster; then the higher mean, then the first seen. history: ord, name, similarity."""
    names = history.groupBy("recording_id", cluster, "name").agg(F.count(F.lit(1)).alias("occurrences"), F.avg("similarity").alias("avg_similarity"), F.min("ord").alias("__first"))
    w = Window.partitionBy("recording_id", cluster)
    ranked = names.withColumns({"total": F.sum("occurrences").over(w), "__r": F.row_number().over(w.orderBy(F.desc("occurrences"), F.desc("avg_similarity"), "__first"))})
    return ranked.where("__r = 1").drop("__r", "__first")


def build_hypothesis(segments: DataFrame, config: Inference = Inference(), unknowns: DataFrame | None = None) -> DataFrame:
    """Participants of each recording, best first. unknowns: recording_id, speaker_name, segment_count, unknown_id, closest_enrolled."""
    stats = assignment_stats(segments).where(F.col("segment_count") >= config.min_occurrences)
    rows = stats.select("recording_id", "speaker_name", "segment_count", "avg_similarity", "is_unknown", "first_index", F.lit(None).cast("int").alias("unknown_id"), F.lit(None).cast("string").alias("closest_enrolled"))
    if unknowns is not None:
        sure = unknown_confidence(F.col("segment_count"), config.min_occurrences)
        other = unknowns.select("recording_id", "speaker_name", "segment_count", sure.alias("avg_similarity"), F.lit(True).alias("is_unknown"), F.lit(None).cast("long").alias("first_index"), "unknown_id", "closest_enrolled").where("avg_similarity IS NOT NULL")
        both = rows.withColumn("__own", F.lit(0)).unionByName(other.withColumn("__own", F.lit(1)))
        first = lambda c: F.min_by(c, "__own").alias(c)
        rows = both.groupBy("recording_id", "speaker_name").agg(first("segment_count"), first("avg_similarity"), F.max("is_unknown").alias("is_unknown"), F.min("first_index").alias("first_index"), F.max("unknown_id").alias("unknown_id"), F.max("closest_enrolled").alias("closest_enrolled"))
    rows = rows.withColumn("score", F.col("segment_count") * F.col("avg_similarity"))
    order = Window.partitionBy("recording_id").orderBy(F.desc(F.col("score") + F.when(F.col("is_unknown"), 0.0).otherwise(0.1)), F.col("first_index").asc_nulls_last(), "unknown_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.expected_speakers).drop("first_index")


def participants_beside(rows: DataFrame, config: Inference = Inference()) -> DataFrame:
    """Adds each recording's participants (build_hypothesis, join_hypothesis) to all its rows by windows of the recording.

    rows: recording_id, segment_index, is_environmental, speaker_label, similarity, and __listed, whether they have
    candidates. Rows that lie by recording stay there. A recording's list holds each of its labels once.
    """
    own = ~F.col("is_environmental")
    label = F.when(own, F.col("speaker_label"))
    whole = lambda *by: Window.partitionBy(*by).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__label", label)
    by = whole("recording_id", "__label")
    n, first = F.count(F.lit(1)).over(by), F.min("segment_index").over(by)
    rows = rows.withColumns({"__n": n, "__mean": F.coalesce(F.avg("similarity").over(by), F.lit(0.5)), "__first": first})
    unknown = F.col("__label").startswith("Unknown")
    standing = F.struct((-(F.col("__n") * F.col("__mean") + F.when(unknown, 0.0).otherwise(0.1))).alias("minus"), F.col("__first").alias("first"), F.col("__label").alias("name"), unknown.alias("is_unknown"))
    once = F.col("__label").isNotNull() & (F.col("segment_index") == F.col("__first")) & (F.col("__n") >= config.min_occurrences)
    recording = Window.partitionBy("recording_id")
    counted = F.count_if(own & (F.col("speaker_label").isNotNull() | F.col("__listed"))).over(recording)
    rows = rows.withColumns({"__all": F.collect_list(F.when(once, standing)).over(recording), "__counted": counted})
    top = F.transform(F.slice(F.array_sort("__all"), 1, config.expected_speakers), lambda p: F.struct(p["name"].alias("name"), p["is_unknown"].alias("is_unknown")))
    none = F.array().cast("array<struct<name:string,is_unknown:boolean>>")
    return rows.withColumn("participants", F.when(F.col("__counted") >= config.min_segments, top).otherwise(none)).drop("__label", "__n", "__mean", "__first", "__all", "__counted")


def boost_attributions(segments: DataFrame, config: Inference = Inference()) -> DataFrame:
    """Boosting of segments with `candidates`, `speaker_label` and `participants` (array of name, is_unknown), as pure column logic."""
    c, parts = F.col("candidates"), F.col("participants")
    best, second = nth(c, 0), nth(c, 1)
    names = F.transform(parts, lambda p: p["name"])
    in_names = lambda n: F.coalesce(F.array_contains(names, n), F.lit(False))
    unknown_names = F.transform(F.filter(parts, lambda p: p["is_unknown"]), lambda p: p["name"])
    best_in, second_in = in_names(best["name"]), second.isNotNull() & in_names(second["name"])
    unknown_wins = (F.col("unknown_id").isNotNull() & in_names(F.col("speaker_label"))) if "unknown_id" in segments.columns else F.lit(False)
    skip = (
        F.when(F.size(c) == 0, "no_matches").when(best["similarity"] >= config.confident, "already_confident").when(margin(c, "boost") >= config.ambiguity_margin, "clear_winner")
        .when(best["similarity"] < config.min_for_boost, "low_similarity").when(F.size(parts) == 0, "no_hypothesis").when(unknown_wins, "unknown_participant_better")
        .when(best_in & ~second_in, "participant_already_winning").when(~second_in, "no_participant_contender")
    )
    rows = segments.withColumns({"skip_reason": skip, "__both": best_in & second_in, "__second": ~best_in & second_in})

    def boosted(x: Column, i: Column) -> Column:
        eligible = in_names(x["name"]) & (i < config.eligible_rank) & (F.col("__both") | (F.col("__second") & (i == 1)))
        factor = F.when(F.array_contains(unknown_names, x["name"]), config.unknown_boost).otherwise(config.boost)
        similarity = F.when(eligible, F.least(F.lit(1.0), x["similarity"] * factor)).otherwise(x["similarity"])
        return F.struct((-similarity).alias("minus"), i.alias("i"), x["name"].alias("name"), x["similarity"].alias("original"), eligible.alias("boosted"))

    rows = rows.withColumn("__m", F.when(F.col("skip_reason").isNull(), F.array_sort(F.transform(c, boosted))))
    top, next_ = nth(F.col("__m"), 0), nth(F.col("__m"), 1)
    done = F.col("skip_reason").isNull()
    new_margin = F.when(next_.isNotNull(), next_["minus"] - top["minus"]).otherwise(1.0)
    low = -top["minus"] < config.min_after_boost
    reason = F.when(~done, F.lit(None)).when(low, "below_boost_threshold").when((new_margin < config.final_margin) & (F.size(c) > 1), "ambiguous_boosted").otherwise("boosted_match")
    return rows.select(
        *segments.columns, "skip_reason", done.alias("boosted"),
        F.when(~done, F.col("speaker_label")).when(low, "Unknown").otherwise(top["name"]).alias("final_name"),
        F.when(done, top["name"]).otherwise(best["name"]).alias("best_name"), F.when(done, -top["minus"]).otherwise(best["similarity"]).alias("best_similarity"),
        F.when(done, new_margin).alias("final_margin"), (done & (top["name"] != best["name"])).alias("was_influenced"), reason.alias("boost_reason"),
    )


def display_label(rows: DataFrame, config: Inference = Inference()) -> DataFrame:
    """Unknown, `Unexpected: X` for an unlikely outsider, or X."""
    names = F.transform("participants", lambda p: p["name"])
    unexpected = ~F.array_contains(names, F.col("best_name")) & (F.col("best_similarity") < config.unexpected) & (F.size("participants") > 0)
    label = F.when(F.col("best_name").isNull() | (F.col("final_name") == "Unknown"), "Unknown").when(unexpected, F.concat(F.lit("Unexpected: "), F.col("best_name"))).otherwise(F.col("best_name"))
    return rows.withColumns({"is_unexpected": F.coalesce(unexpected, F.lit(False)), "display_label": label})


def join_hypothesis(segments: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Adds each recording's participants, an empty array without any."""
    lists = hypothesis.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("speaker_name").alias("name"), "is_unknown"))).alias("__p"))
    plain = F.transform("__p", lambda p: F.struct(p["name"].alias("name"), p["is_unknown"].alias("is_unknown")))
    return segments.join(lists, "recording_id", "left").withColumn("participants", F.coalesce(plain, F.array().cast("array<struct<name:string,is_unknown:boolean>>"))).drop("__p")


def infer_conversation(segments: DataFrame, config: Inference = Inference(), unknowns: DataFrame | None = None) -> DataFrame:
    """Hypothesis from all segments of a recording, then boosting and labels for those with candidates."""
    counted = segments.where("NOT is_environmental") if "is_environmental" in segments.columns else segments
    enough = counted.where(F.col("speaker_label").isNotNull() | (F.size("candidates") > 0)).groupBy("recording_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= config.min_segments).select("recording_id")
    hypothesis = build_hypothesis(counted, config, unknowns).join(enough, "recording_id", "left_semi")
    rows = join_hypothesis(counted.where(F.size("candidates") > 0), hypothesis)
    return display_label(boost_attributions(rows, config), config)


def participant_diff(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Added, removed, and whether the sets differ."""
    added, removed = F.array_except(after, before), F.array_except(before, after)
    return added, removed, (F.size(added) > 0) | (F.size(removed) > 0)


def changed_attributions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments whose display label differs."""
    o = old.select(*SEGMENT, F.col("display_label").alias("old_label"))
    return o.join(new.select(*SEGMENT, F.col("display_label").alias("new_label")), SEGMENT).where(~F.col("old_label").eqNullSafe(F.col("new_label")))


def effective_speaker(attribution: DataFrame) -> DataFrame:
    """The boosted best when boosting changed the outcome, else the display label, else the original one."""
    return attribution.withColumn("effective_speaker", F.when(F.col("was_influenced"), F.col("best_name")).otherwise(F.coalesce(F.col("display_label"), F.col("speaker_label"))))


def boost_stats(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("recording_id").agg(F.count_if("boosted").alias("n_boosted"), F.count_if(F.col("skip_reason").isNotNull()).alias("n_skipped"), F.count_if("was_influenced").alias("n_changed"))


def extract_participants(segments: DataFrame, keys: list[str]) -> DataFrame:
    """For each speaker id: first label, segment count. Environmental rows and null ids don't count."""
    return segments.where(F.col("speaker_id").isNotNull()).groupBy(*keys, "speaker_id").agg(F.min_by("speaker_label", "segment_index").alias("label"), F.count(F.lit(1)).alias("segment_count"))


HISTORY = "recording_id long, version int, total_segments int, added array<string>, removed array<string>, participants array<string>"


class Standing:
    """The first few labels of a recording by score, kept up as segments come."""

    def __init__(self, config: Inference):
        self.config, self.n, self.labels, self.top = config, 0, {}, []
        self.version, self.shown = 0, []

    def rank(self, label: str) -> tuple[float, int]:
        _, total, first = self.labels[label]
        return -(total + (0.0 if label.startswith("Unknown") else 0.1)), first

    def add(self, label: str, similarity: float) -> tuple[list[str], list[str]] | None:
        """Takes the next segment; participants that came and went if this is a checkpoint at which they changed."""
        self.n += 1
        k, total, first = self.labels.get(label, (0, 0.0, self.n))
        self.labels[label] = k + 1, total + similarity, first
        if k + 1 >= self.config.min_occurrences:
            # only this label's score has changed: others come in only where it falls out of the first few
            if similarity < 0 and label in self.top:
                able = [x for x, (count, _, _) in self.labels.items() if count >= self.config.min_occurrences]
                self.top = heapq.nsmallest(self.config.expected_speakers, able, key=self.rank)
            else:
                self.top = sorted({*self.top, label}, key=self.rank)[: self.config.expected_speakers]
        if self.n < self.config.min_segments or not self.top or (self.version and self.n % 2):
            return None
        now = sorted(self.top)
        added, removed = [x for x in now if x not in self.shown], [x for x in self.shown if x not in now]
        if not added and not removed:
            return None
        self.version, self.shown = self.version + 1, now
        return added, removed


def hypothesis_history(segments: DataFrame, config: Inference = Inference()) -> DataFrame:
    """Participants of a growing recording, whenever a checkpoint changes them: every n from min_segments on until some are
    found, then every second n.

    A segment changes one label's count, so the first few labels are kept up and never ranked anew: one pass over a
    recording's segments in order, with its labels in memory. Only what changes is returned.
    """
    counted = segments.where((F.size("candidates") > 0) & F.col("speaker_label").isNotNull())
    slim = counted.select(F.col("recording_id").cast("long").alias("recording_id"), F.col("segment_index").cast("long").alias("i"), "speaker_label", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    n = max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recording, standing = None, None
        for b in batches:
            out = []
            columns = (b.column(c).to_pylist() for c in ("recording_id", "speaker_label", "similarity"))
            for rec, label, similarity in zip(*columns, strict=True):
                if standing is None or rec != recording:
                    recording, standing = rec, Standing(config)
                change = standing.add(label, similarity)
                if change:
                    out.append((rec, standing.version, standing.n, *change, standing.shown))
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.string())] * 3)
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in HISTORY.split(", ")])

    return slim.repartition(n, "recording_id").sortWithinPartitions("recording_id", "i").mapInArrow(run, HISTORY)


def history_tail(history: DataFrame, n: int = 5) -> DataFrame:
    last = Window.partitionBy("recording_id").orderBy(F.desc("version"))
    return history.withColumn("recency", F.row_number().over(last)).where(F.col("recency") <= n)
