"""Scoring phrases against speakers, assignment, and the roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.config import Clustering
from voxspark.functions import vectors as V
from voxspark.operators.beside import beside


def score_candidates(phrases: DataFrame, roster: DataFrame, key: str | None = None, vector: str = "embedding") -> DataFrame:
    """Adds `candidates`: every speaker of the key's roster with its cosine, best first, roster order on ties.

    roster: idx, name, centroid (and the key). A key's roster is one row with one array, so phrases meet
    it in an equality join and never multiply.
    """
    scored = with_similarities(phrases, roster, key, vector, "__s", "__list")
    return scored.withColumn("candidates", candidates_of(F.col("__list"), F.col("__s"))).drop("__list", "__s")


def with_similarities(phrases: DataFrame, roster: DataFrame, key: str | None = None, vector: str = "embedding", out: str = "similarities", listed: str | None = None) -> DataFrame:
    """Adds each row's cosine to every speaker of the roster, in the order of `speakers_of`; the list itself too, if it is given a name."""
    speaker = F.struct("idx", "name", V.l2_normalize(F.col("centroid")).alias("c"))
    lists = roster.groupBy(*([key] if key else [])).agg(F.array_sort(F.collect_list(speaker)).alias("__speakers"))
    scored = phrases.join(lists, key, "left") if key else beside(phrases, roster, lists)
    scored = scored.withColumn("__v", V.l2_normalize(F.col(vector)))
    one = lambda s: F.when(F.col("__v").isNotNull() & (F.size("__v") == F.size(s["c"])), V.dot(F.col("__v"), s["c"])).otherwise(0.0)
    scored = scored.withColumn(out, F.transform("__speakers", one)).drop("__v")
    return scored.withColumnRenamed("__speakers", listed) if listed else scored.drop("__speakers")


def speakers_of(rows: DataFrame, roster: DataFrame, out: str) -> DataFrame:
    """Adds the roster's idx and name as an array, for similarities that were kept without them."""
    speaker = F.struct("idx", "name", V.l2_normalize(F.col("centroid")).alias("c"))
    plain = F.transform(F.array_sort(F.collect_list(speaker)), lambda s: F.struct(s["idx"].alias("idx"), s["name"].alias("name")))
    return beside(rows, roster, roster.agg(plain.alias(out)))


def candidates_of(speakers: Column, similarities: Column) -> Column:
    """Speakers with their similarities, best first, roster order on ties."""
    one = lambda s, x: F.struct((-x).alias("minus"), s["idx"].alias("idx"), s["name"].alias("name"))
    plain = F.transform(F.array_sort(F.zip_with(speakers, similarities, one)), lambda c: F.struct(c["idx"].alias("idx"), c["name"].alias("name"), (-c["minus"]).alias("similarity")))
    return F.coalesce(plain, F.array().cast("array<struct<idx:int,name:string,similarity:double>>"))


def nth(candidates: Column, n: int) -> Column:
    return F.get(candidates, F.lit(n))


def margin(candidates: Column, mode: str = "cluster") -> Column:
    """Best less second. With one candidate: similarity + 1 for the clusterer, 1 for boosting, similarity for unknowns."""
    best, second = nth(candidates, 0)["similarity"], nth(candidates, 1)["similarity"]
    if mode == "boost":
        return F.when(second.isNotNull(), best - second).otherwise(F.lit(1.0))
    if mode == "unknown":
        return best - F.greatest(F.coalesce(second, F.lit(0.0)), F.lit(0.0))
    return best - F.coalesce(second, F.lit(-1.0))


def second_best_speaker(candidates: Column) -> Column:
    """The first other candidate within 0.001 of the second best similarity, if that is positive."""
    second = nth(candidates, 1)["similarity"]
    others = F.slice(candidates, 2, F.greatest(F.size(candidates) - 1, F.lit(0)))
    near = F.filter(others, lambda c: F.abs(c["similarity"] - second) < 0.001)
    first = F.array_min(F.transform(near, lambda c: F.struct(c["idx"], c["name"])))
    return F.when(second > 0, first["name"])


def assign_enrolled_only(scored: DataFrame, config: Clustering = Clustering(), vector: str = "embedding") -> DataFrame:
    """Assignment against a closed roster; the same as the online clusterer when the roster has num_speakers or more."""
    best = nth(F.col("candidates"), 0)
    m = margin(F.col("candidates"))
    sure = best["similarity"] >= config.similarity
    ambiguous = sure & (F.size("candidates") > 1) & (m < config.margin)
    reason = (
        F.when(F.col(vector).isNull(), "no_embedding").when(ambiguous, "ambiguous_match").when(sure, "confident_match")
        .when(best["similarity"] < config.minimum, "below_minimum_threshold").otherwise("no_confident_match")
    )
    speaker = F.when(F.col(vector).isNull(), 0).when(sure & ~ambiguous, best["idx"]).otherwise(-1)
    return scored.withColumns({"speaker_id": speaker, "speaker_label": F.when(F.col(vector).isNotNull() & sure & ~ambiguous, best["name"]).otherwise("Unknown"), "similarity": best["similarity"], "margin": m, "reason": reason})


def enrollment_centroid(samples: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """Centroid of the normalised samples without outliers; under two survivors all samples count."""
    unit = samples.select(key, "sample_id", V.l2_normalize(F.col("embedding")).alias("u")).where("u IS NOT NULL")
    first = V.mean_vector(unit, [key], "u", "m").select(key, V.l2_normalize(F.col("m")).alias("m"))
    per_key = Window.partitionBy(key)
    judged = unit.join(first, key).withColumn("ok", V.dot(F.col("u"), F.col("m")) >= threshold)
    judged = judged.withColumns({"n_ok": F.count_if("ok").over(per_key), "n_all": F.count(F.lit(1)).over(per_key)})
    used = judged.where(F.col("ok") | (F.col("n_ok") < 2))
    centroid = V.mean_vector(used, [key], "u", "m").select(key, V.l2_normalize(F.col("m")).alias("centroid"))
    rejected = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("sample_id"))))
    report = judged.groupBy(key).agg(rejected.alias("rejected"), F.max("n_all").alias("n_samples"), F.max("n_ok").alias("n_ok"))
    fallback = ((F.col("n_ok") < 2) & (F.size("rejected") > 0)) | (F.size("rejected") / F.col("n_samples") > 0.5)
    return centroid.join(report.withColumn("used_fallback", fallback), key)


def recompute_centroid(samples: DataFrame, key: str, normalize: bool = True) -> DataFrame:
    mean = V.mean_vector(samples, [key], "embedding", "centroid")
    return mean.withColumn("centroid", V.l2_normalize(F.col("centroid"))) if normalize else mean


def enrollment_pairs(roster: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine of each two enrollments of a key (idx_a < idx_b), from one array a key."""
    lists = roster.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "name", V.l2_normalize(F.col("centroid")).alias("c")))).alias("__l"))
    a = lists.select(*keys, "__l", F.posexplode("__l").alias("__i", "a"))
    b = a.select(*keys, "a", F.explode(F.slice("__l", F.col("__i") + 2, F.size("__l"))).alias("b"))
    return b.select(*keys, F.col("a.idx").alias("idx_a"), F.col("a.name").alias("name_a"), F.col("b.idx").alias("idx_b"), F.col("b.name").alias("name_b"), V.dot(F.col("a.c"), F.col("b.c")).alias("similarity"))


def prepare_enrollments(snapshot: DataFrame, store: DataFrame, model: str, default_model: str) -> DataFrame:
    """Embedding for the model from the snapshot's map, else the store's, else the legacy centroid for the default model; without one dropped."""
    s = store.select("enrollment_id", F.col("embeddings").alias("__stored"))
    legacy = F.when(F.lit(model == default_model), F.col("centroid"))
    found = F.coalesce(F.get(F.array(F.col("embeddings")[model]), F.lit(0)), F.col("__stored")[model], legacy)
    return snapshot.join(s, "enrollment_id", "left").withColumn("vector", found).where("vector IS NOT NULL").select("enrollment_id", "name", "vector")


def enrollments_needing_embeddings(enrollments: DataFrame, audio: DataFrame, model: str) -> DataFrame:
    """With audio and without an embedding for the model."""
    return enrollments.where(F.col("embeddings").isNull() | F.col("embeddings")[model].isNull()).join(audio.select("enrollment_id").distinct(), "enrollment_id", "left_semi")


def available_models(enrollments: DataFrame, default_model: str) -> DataFrame:
    """Models with embeddings and how many enrollments each covers; legacy centroids count for the default model."""
    mapped = F.coalesce(F.map_keys("embeddings"), F.array().cast("array<string>"))
    models = F.when((F.size(mapped) == 0) & F.col("centroid").isNotNull(), F.array(F.lit(default_model))).otherwise(mapped)
    return enrollments.select("enrollment_id", F.explode(models).alias("model_id")).groupBy("model_id").agg(F.countDistinct("enrollment_id").alias("n_enrollments"))


def import_enrolled(speakers: DataFrame, enrolled: DataFrame) -> DataFrame:
    """The given enrolled speakers, normalised and those without centroid left out, before the discovered ones; ids anew."""
    new = enrolled.where("centroid IS NOT NULL").select(F.lit(0).alias("__kind"), F.col("idx").alias("__ord"), "name", V.l2_normalize(F.col("centroid")).alias("centroid"), F.lit(True).alias("enrolled"), *[c for c in ("recording_id",) if c in enrolled.columns])
    old = speakers.where("NOT enrolled").select(F.lit(1).alias("__kind"), F.col("speaker_id").alias("__ord"), "name", V.doubles(F.col("centroid")).alias("centroid"), "enrolled", *[c for c in ("recording_id",) if c in speakers.columns])
    keys = [c for c in ("recording_id",) if c in old.columns]
    both = new.unionByName(old)
    return both.withColumn("speaker_id", F.row_number().over(Window.partitionBy(*keys).orderBy("__kind", "__ord")) - 1).drop("__kind", "__ord")


def export_enrolled(speakers: DataFrame) -> DataFrame:
    return speakers.where("enrolled")


def clear_enrolled(speakers: DataFrame) -> DataFrame:
    return speakers.where("NOT enrolled")


def remove_enrolled(speakers: DataFrame, name: str) -> DataFrame:
    return speakers.where(~(F.col("enrolled") & (F.col("name") == name)))


def compare_segments(segments: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine of requested pairs (a, b) of segments. pairs: keys, a, b."""
    side = lambda n: segments.select(*keys, F.col("segment_index").alias(n), F.col("embedding").alias(f"__{n}"), F.col("speaker").alias(f"__s{n}"))
    rows = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    missing = F.col("__a").isNull() | F.col("__b").isNull()
    similarity = F.when(~missing, V.cosine_similarity(F.col("__a"), F.col("__b")))
    return rows.select(*keys, "a", "b", similarity.alias("similarity"), (similarity >= 0.75).alias("same_likely"), F.col("__sa").eqNullSafe(F.col("__sb")).alias("same_actual"), F.when(missing, "missing_embedding").alias("error"))
