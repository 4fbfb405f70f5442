"""Scoring, assignment, rosters and separation metrics over the bound voices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxspark.config import Clustering
from voxspark.functions import vectors as V
from voxspark.functions.text import confusability
from voxspark.operators import metrics as M
from voxspark.operators import speakers as S
from voxspark.plans.registry import query

#: Thresholds that suit random vectors.
SCALED = Clustering(similarity=0.2, minimum=0.1, margin=0.02)
# F.round alone makes 0.0 of a small negative number, where SQL keeps the sign: -0.0
r6 = lambda c: F.round(F.abs(c), 6) * F.signum(c)
v6 = lambda c: F.transform(c, r6)
NEXT = "SELECT * FROM (SELECT ord, recording_id, embedding AS a, lead(embedding) OVER (PARTITION BY recording_id ORDER BY ord) AS b FROM voices) WHERE b IS NOT NULL"


def neighbours(t):
    return t.voices.withColumn("b", F.lead("embedding").over(Window.partitionBy("recording_id").orderBy("ord"))).where("b IS NOT NULL").withColumnRenamed("embedding", "a")


def roster(t):
    return t.roster.withColumn("idx", F.col("enrollment_id"))


def scored(t):
    return S.score_candidates(t.voices.drop("label"), roster(t))


@query("H1_l2_normalize", "SELECT ord, list_transform(embedding, lambda x: round(x / sqrt(list_dot_product(embedding, embedding)), 6)) AS u FROM voices")
def _(t):
    return t.voices.select("ord", v6(V.l2_normalize(F.col("embedding"))).alias("u"))


@query("H2_cosine_similarity", f"SELECT ord, round(list_cosine_similarity(a, b), 6) AS s FROM ({NEXT})")
def _(t):
    return neighbours(t).select("ord", r6(V.cosine_similarity(F.col("a"), F.col("b"))).alias("s"))


@query("H3_dot", f"SELECT ord, round(list_dot_product(a, b), 6) AS s FROM ({NEXT})")
def _(t):
    return neighbours(t).select("ord", r6(V.dot(F.col("a"), F.col("b"))).alias("s"))


@query(
    "H16_blend_centroid",
    f"""WITH p AS (SELECT ord, a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS u, 1 + ord % 4 AS n FROM ({NEXT})),
        q AS (SELECT ord, n, a, [(a[i] * n + u[i]) / (n + 1) for i in range(1, len(a) + 1)] AS m, [(a[i] * n - u[i]) / (n - 1) for i in range(1, len(a) + 1)] AS k FROM p)
        SELECT ord, [round(x / sqrt(list_dot_product(m, m)), 6) for x in m] AS blended, CASE WHEN n <= 1 OR ord % 3 = 0 THEN [round(x, 6) for x in a] ELSE [round(x / sqrt(list_dot_product(k, k)), 6) for x in k] END AS unblended FROM q""",
)
def _(t):
    n = 1 + F.col("ord") % 4
    rows = neighbours(t)
    return rows.select("ord", v6(V.blend_centroid(F.col("a"), n, F.col("b"))).alias("blended"), v6(V.unblend_centroid(F.col("a"), n, F.col("b"), F.col("ord") % 3 == 0)).alias("unblended"))


@query("A25_vector_diagnostics", "SELECT ord, len(embedding) AS dim, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm, round(list_avg(embedding), 6) AS mean, round(list_min(embedding), 6) AS least, round(list_max(embedding), 6) AS most FROM voices")
def _(t):
    return M.vector_diagnostics(t.voices).select("ord", F.col("dim").cast("long").alias("dim"), r6("norm").alias("norm"), r6("mean").alias("mean"), r6("least").alias("least"), r6("most").alias("most"))


MEANS = "(SELECT enrollment_id, list(a ORDER BY i) AS m FROM (SELECT enrollment_id, i, avg(embedding[i]) AS a FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM samples) GROUP BY enrollment_id, i) GROUP BY enrollment_id)"


@query("A1_mean_vector", f"SELECT enrollment_id, list_transform(m, lambda x: round(x, 6)) AS mean FROM {MEANS}")
def _(t):
    return V.mean_vector(t.samples, ["enrollment_id"], "embedding").select("enrollment_id", v6("mean").alias("mean"))


@query("A3_recompute_centroid", f"SELECT enrollment_id, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6)) AS centroid FROM {MEANS}")
def _(t):
    return S.recompute_centroid(t.samples, "enrollment_id").select("enrollment_id", v6("centroid").alias("centroid"))


@query(
    "A2_enrollment_centroid",
    """WITH u AS (SELECT enrollment_id, sample_id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u FROM samples),
       j AS (SELECT u.*, list_dot_product(u, centroid) >= 0.1 AS ok, count(*) FILTER (WHERE list_dot_product(u, centroid) >= 0.1) OVER (PARTITION BY u.enrollment_id) AS n_ok, count(*) OVER (PARTITION BY u.enrollment_id) AS n_all FROM u JOIN roster r ON r.enrollment_id = u.enrollment_id),
       m AS (SELECT enrollment_id, list(a ORDER BY i) AS m FROM (SELECT enrollment_id, i, avg(u[i]) AS a FROM (SELECT enrollment_id, u, unnest(range(1, len(u) + 1)) AS i FROM j WHERE ok OR n_ok < 2) GROUP BY enrollment_id, i) GROUP BY enrollment_id)
       SELECT m.enrollment_id, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6)) AS centroid, r.rejected, n_samples, (n_ok < 2 AND len(rejected) > 0) OR len(rejected) / CAST(n_samples AS DOUBLE) > 0.5 AS used_fallback
       FROM m JOIN (SELECT enrollment_id, coalesce(list(sample_id ORDER BY sample_id) FILTER (WHERE NOT ok), []) AS rejected, max(n_all) AS n_samples, max(n_ok) AS n_ok FROM j GROUP BY enrollment_id) r USING (enrollment_id)""",
)
def _(t):
    return S.enrollment_centroid(t.samples, "enrollment_id", 0.1).select("enrollment_id", v6("centroid").alias("centroid"), "rejected", "n_samples", "used_fallback")


@query("J1_score_candidates", "SELECT ord, enrollment_id AS idx, round(list_cosine_similarity(embedding, centroid), 6) AS similarity FROM voices, roster")
def _(t):
    return scored(t).select("ord", F.inline("candidates")).select("ord", "idx", r6("similarity").alias("similarity"))


@query("E1_rank_candidates", "SELECT ord, name, CAST(rank AS BIGINT) AS rank, round(similarity, 6) AS similarity FROM ranked")
def _(t):
    rows = scored(t).select("ord", F.posexplode("candidates").alias("p", "c"))
    return rows.select("ord", F.col("c.name").alias("name"), (F.col("p") + 1).cast("long").alias("rank"), r6("c.similarity").alias("similarity"))


@query("F1_top_candidates", "SELECT ord, list(name ORDER BY rank) AS top FROM ranked WHERE rank <= 3 GROUP BY ord")
def _(t):
    return scored(t).select("ord", F.transform(F.slice("candidates", 1, 3), lambda c: c["name"]).alias("top"))


@query("E2_margin", "SELECT ord, round(max(similarity) FILTER (WHERE rank = 1) - max(similarity) FILTER (WHERE rank = 2), 6) AS m, round(max(similarity) FILTER (WHERE rank = 1) - greatest(0, max(similarity) FILTER (WHERE rank = 2)), 6) AS m_unknown FROM ranked GROUP BY ord")
def _(t):
    c = F.col("candidates")
    return scored(t).select("ord", r6(S.margin(c)).alias("m"), r6(S.margin(c, "unknown")).alias("m_unknown"))


@query(
    "E13_second_best_speaker",
    """SELECT ord, CASE WHEN max(s2) > 0 THEN min_by(name, idx) FILTER (WHERE rank > 1 AND abs(similarity - s2) < 0.001) END AS second FROM (SELECT *, max(similarity) FILTER (WHERE rank = 2) OVER (PARTITION BY ord) AS s2 FROM ranked) GROUP BY ord""",
)
def _(t):
    return scored(t).select("ord", S.second_best_speaker(F.col("candidates")).alias("second"))


@query("C2_assign_enrolled_only", "SELECT ord, recording_id, speaker_id, speaker_label, round(similarity, 6) AS similarity, round(margin, 6) AS margin, reason FROM assigned")
def _(t):
    rows = S.assign_enrolled_only(scored(t), SCALED)
    return rows.select("ord", "recording_id", F.col("speaker_id").cast("int").alias("speaker_id"), "speaker_label", r6("similarity").alias("similarity"), r6("margin").alias("margin"), "reason")


PAIRS = "(SELECT a.model_id, a.enrollment_id AS idx_a, b.enrollment_id AS idx_b, a.name AS name_a, b.name AS name_b, list_cosine_similarity(a.centroid, b.centroid) AS similarity FROM roster a JOIN roster b ON a.model_id = b.model_id AND a.enrollment_id < b.enrollment_id)"


@query("J10_similar_enrollment_pairs", f"SELECT model_id, name_a, name_b, round(similarity, 6) AS similarity FROM {PAIRS} WHERE similarity > -0.05")
def _(t):
    return S.enrollment_pairs(roster(t), ["model_id"]).where("similarity > -0.05").select("model_id", "name_a", "name_b", r6("similarity").alias("similarity"))


@query("P20_confusability_status", f"SELECT name_a, name_b, CASE WHEN similarity * 10 > 0.75 THEN 'HIGH' WHEN similarity * 10 > 0.65 THEN 'MODERATE' ELSE 'NORMAL' END AS status FROM {PAIRS}")
def _(t):
    return S.enrollment_pairs(roster(t), ["model_id"]).select("name_a", "name_b", confusability(F.col("similarity") * 10).alias("status"))


@query("A4_mean_pairwise_similarity", f"SELECT model_id, round(avg(similarity), 6) AS mean_similarity FROM {PAIRS} GROUP BY model_id")
def _(t):
    return M.mean_pairwise_similarity(roster(t), ["model_id"]).withColumn("mean_similarity", r6("mean_similarity"))


@query("A5_most_confusable_pair", f"SELECT model_id, name_a, name_b, round(similarity, 6) AS similarity FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY similarity DESC, idx_a, idx_b) = 1")
def _(t):
    return M.most_confusable_pair(roster(t), ["model_id"]).withColumn("similarity", r6("similarity"))


SIL = """(WITH s AS (SELECT CASE WHEN label < 5 THEN 'm0' ELSE 'm1' END AS model_id, label AS c, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
          d AS (SELECT x.model_id, x.vec_id, x.c, y.c AS o, sum(1 - list_cosine_similarity(x.e, y.e)) AS total, count(*) AS n FROM s x JOIN s y ON x.model_id = y.model_id GROUP BY ALL),
          v AS (SELECT model_id, vec_id, max(CASE WHEN c = o THEN total / CAST(n - 1 AS DOUBLE) END) AS a, min(CASE WHEN c <> o THEN total / CAST(n AS DOUBLE) END) AS b FROM d GROUP BY ALL)
          SELECT model_id, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM v GROUP BY model_id)"""


def model_samples(t):
    return t.samples.withColumns({"model_id": F.when(F.col("enrollment_id") < 5, "m0").otherwise("m1"), "idx": F.col("enrollment_id")})


@query("A6_silhouette", f"SELECT model_id, round(silhouette, 6) AS silhouette FROM {SIL}")
def _(t):
    return M.silhouette(model_samples(t), ["model_id"], "idx").withColumn("silhouette", r6("silhouette"))


SIMPLE = f"(SELECT model_id, avg(d) - 1 AS silhouette FROM (SELECT model_id, i, 1 - max(similarity) AS d FROM (SELECT model_id, idx_a AS i, similarity FROM {PAIRS} UNION ALL SELECT model_id, idx_b, similarity FROM {PAIRS}) GROUP BY model_id, i) GROUP BY model_id)"


@query("A7_simplified_silhouette", f"SELECT model_id, round(silhouette, 6) AS silhouette FROM {SIMPLE}")
def _(t):
    return M.simplified_silhouette(roster(t), ["model_id"]).withColumn("silhouette", r6("silhouette"))


@query(
    "A8_discriminability_report",
    f"""SELECT r.model_id, r.n_speakers, round(m.s, 6) AS mean_similarity, p.name_a, p.name_b, round(p.similarity, 6) AS max_similarity, round(s.silhouette, 6) AS silhouette
        FROM (SELECT model_id, count(*) AS n_speakers FROM roster GROUP BY model_id) r JOIN (SELECT model_id, avg(similarity) AS s FROM {PAIRS} GROUP BY model_id) m USING (model_id)
        JOIN (SELECT * FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY similarity DESC, idx_a, idx_b) = 1) p USING (model_id) JOIN {SIL} s USING (model_id)""",
)
def _(t):
    out = M.discriminability_report(model_samples(t), roster(t), "model_id")
    return out.withColumns({c: r6(c) for c in ("mean_similarity", "max_similarity", "silhouette")})


@query("C10_pca_2d")
def _(t):
    return M.pca_2d(t.voices, "ord").select("ord", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "J11_compare_segments",
    """SELECT a.recording_id, a.ord AS a, b.ord AS b, CASE WHEN a.ord % 9 <> 0 AND b.ord % 9 <> 0 THEN round(list_cosine_similarity(a.embedding, b.embedding), 6) END AS similarity, a.label = b.label AS same_actual, CASE WHEN a.ord % 9 = 0 OR b.ord % 9 = 0 THEN 'missing_embedding' END AS error
       FROM voices a JOIN voices b ON a.recording_id = b.recording_id AND b.ord = a.ord + 20""",
)
def _(t):
    seg = t.voices.select("recording_id", F.col("ord").alias("segment_index"), F.when(F.col("ord") % 9 != 0, F.col("embedding")).alias("embedding"), F.col("label").alias("speaker"))
    pairs = neighbours(t).select("recording_id", F.col("ord").alias("a"), (F.col("ord") + 20).alias("b"))
    return S.compare_segments(seg, pairs, ["recording_id"]).select("recording_id", "a", "b", r6("similarity").alias("similarity"), "same_actual", "error")


def stored(t):
    """Enrollments with maps of embeddings; some only have a legacy centroid, some neither."""
    i = F.col("enrollment_id")
    maps = F.when(i % 3 == 0, F.create_map(F.lit("m0"), F.col("centroid"))).when(i % 3 == 1, F.create_map(F.lit("m1"), F.col("centroid")))
    return t.roster.select("enrollment_id", "name", maps.alias("embeddings"), F.when((i % 3 == 2) & (i != 5), F.col("centroid")).alias("centroid"))


@query("S4_read_enrollments", "SELECT enrollment_id, name FROM roster WHERE enrollment_id % 3 = 0 OR (enrollment_id % 3 = 2 AND enrollment_id <> 5)")
def _(t):
    return S.prepare_enrollments(stored(t), stored(t), "m0", "m0").select("enrollment_id", "name")


@query("J7_prepare_enrollments", "SELECT enrollment_id, name, round(centroid[1], 6) AS first FROM roster WHERE enrollment_id % 3 = 1 OR enrollment_id % 2 = 0")
def _(t):
    snapshot = t.roster.select("enrollment_id", "name", F.when(F.col("enrollment_id") % 2 == 0, F.create_map(F.lit("m1"), F.col("centroid"))).alias("embeddings"), F.lit(None).cast("array<double>").alias("centroid"))
    return S.prepare_enrollments(snapshot, stored(t), "m1", "m0").select("enrollment_id", "name", r6(F.element_at("vector", 1)).alias("first"))


@query("J8_enrollments_needing_embeddings", "SELECT DISTINCT enrollment_id FROM samples WHERE enrollment_id % 3 <> 0 AND sample_id % 7 <> 0")
def _(t):
    return S.enrollments_needing_embeddings(stored(t), t.samples.where("sample_id % 7 <> 0"), "m0").select("enrollment_id")


@query("A29_available_models", "SELECT CASE WHEN enrollment_id % 3 = 1 THEN 'm1' ELSE 'm0' END AS model_id, count(*) AS n_enrollments FROM roster WHERE enrollment_id <> 5 GROUP BY ALL")
def _(t):
    return S.available_models(stored(t), "m0")


def known(t):
    """Speakers of recordings: the first three of each recording's voices, the first of them enrolled."""
    order = Window.partitionBy("recording_id").orderBy("ord")
    rows = t.voices.withColumn("speaker_id", F.row_number().over(order) - 1)
    return rows.select("recording_id", "speaker_id", F.concat(F.lit("V"), F.col("ord").cast("string")).alias("name"), F.col("embedding").alias("centroid"), (F.col("speaker_id") % 4 == 0).alias("enrolled"))


KNOWN = "(SELECT *, speaker_id % 4 = 0 AS enrolled FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ord) - 1 AS speaker_id, 'V' || ord AS name, embedding FROM voices))"


@query(
    "G3_import_enrolled",
    f"""SELECT recording_id, name, enrolled, row_number() OVER (PARTITION BY recording_id ORDER BY k, o) - 1 AS speaker_id FROM (
            SELECT recording_id, 'N' || speaker_id AS name, true AS enrolled, 0 AS k, speaker_id AS o FROM {KNOWN} WHERE speaker_id % 5 <> 4 UNION ALL SELECT recording_id, name, enrolled, 1, speaker_id FROM {KNOWN} WHERE NOT enrolled)""",
)
def _(t):
    new = known(t).select("recording_id", F.col("speaker_id").alias("idx"), F.concat(F.lit("N"), F.col("speaker_id").cast("string")).alias("name"), F.when(F.col("speaker_id") % 5 != 4, F.col("centroid")).alias("centroid"))
    return S.import_enrolled(known(t), new).select("recording_id", "name", "enrolled", F.col("speaker_id").cast("long").alias("speaker_id"))


@query("G4_enrolled_filters", f"SELECT recording_id, name, enrolled AS exported, NOT enrolled AS survives_clear FROM {KNOWN} WHERE NOT (enrolled AND name = 'V0')")
def _(t):
    left = S.remove_enrolled(known(t), "V0")
    out, kept = S.export_enrolled(left).select("recording_id", "name", F.lit(True).alias("exported"), F.lit(False).alias("survives_clear")), S.clear_enrolled(left).select("recording_id", "name", F.lit(False).alias("exported"), F.lit(True).alias("survives_clear"))
    return out.unionByName(kept)


@query("G5_clusters_snapshot", f"SELECT recording_id, speaker_id, name, enrolled, CAST(speaker_id % 6 AS BIGINT) AS color_index FROM {KNOWN}")
def _(t):
    return known(t).select("recording_id", F.col("speaker_id").cast("long").alias("speaker_id"), "name", "enrolled", (F.col("speaker_id") % 6).cast("long").alias("color_index"))
