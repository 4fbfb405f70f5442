"""How the given tables stand in for words, voices, rosters, segments, frames and recordings.

`Tables` builds them as DataFrames; `SQL` holds the same definitions for the comparison.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxspark.functions import vectors as V


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def words(self) -> DataFrame:
        """One row a word of a conversation: 400 ms apart, 500 ms more after a sentence."""
        turn = self.table("conversations").select(
            F.col("conv_id").alias("recording_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("channel_id"), F.col("turn").alias("chunk_index"),
            F.posexplode(F.filter(F.split(F.col("text"), r"[ \t\n\r]+"), lambda t: t != "")).alias("pos", "text"),
        )
        earlier = Window.partitionBy("recording_id", "chunk_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        brk = F.coalesce(F.sum(F.col("text").rlike(r"[.!?]$").cast("int")).over(earlier), F.lit(0))
        begin = 400 * F.col("pos") + 500 * brk
        return turn.select("*", (begin / 1000.0).alias("start"), ((begin + 350) / 1000.0).alias("end"))

    @cached_property
    def marked_words(self) -> DataFrame:
        p = F.col("pos")
        text = F.when(p % 17 == 0, "[BLANK_AUDIO]").when(p % 13 == 0, "[MUSIC]").when(p % 11 == 0, "(laughs)").otherwise(F.col("text"))
        return self.words.withColumn("text", text)

    @cached_property
    def overlap_chunks(self) -> DataFrame:
        """Chunks of ten words with three words of the one before, over whole texts."""
        tokens = self.table("documents").select(F.col("doc_id").alias("recording_id"), F.filter(F.split("text", r"[ \t\n\r]+"), lambda t: t != "").alias("t")).where(F.size("t") > 0)
        k = tokens.select("recording_id", "t", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("t") - 10) / 10)).cast("int"))).alias("chunk_index"))
        first = F.when(F.col("chunk_index") == 0, 0).otherwise(10 * F.col("chunk_index") - 3)
        text = F.slice("t", first + 1, 10 * F.col("chunk_index") + 10 - first)
        word = F.transform(text, lambda x, i: F.struct(i.alias("pos"), x.alias("text"), (i * 500 / 1000.0).alias("start"), ((i + 1) * 500 / 1000.0).alias("end")))
        return k.select("recording_id", "chunk_index", F.when(F.col("chunk_index") == 0, 0.0).otherwise(1.5).alias("overlap"), word.alias("words"))

    @staticmethod
    def timed_words(conversations: DataFrame) -> DataFrame:
        """`words` without windows, so that it works on streams, with the words' event time from 1970 on."""
        tokens = F.filter(F.split("text", r"[ \t\n\r]+"), lambda t: t != "")
        turns = conversations.select(F.col("conv_id").alias("recording_id"), "turn", tokens.alias("t"))
        ends = F.transform("t", lambda x: x.rlike(r"[.!?]$").cast("int"))
        brk = lambda i: F.aggregate(F.slice(F.col("__e"), 1, i), F.lit(0), lambda n, e: n + e)
        starts = F.transform("t", lambda _, i: 400 * i + 500 * brk(i))
        rows = turns.withColumn("__e", ends).select("recording_id", "turn", F.posexplode(starts).alias("pos", "ms"))
        return rows.select("recording_id", "turn", "pos", (F.col("ms") / 1000.0).alias("start"), ((F.col("ms") + 350) / 1000.0).alias("end"), F.timestamp_millis("ms").alias("at"))

    @staticmethod
    def talk_chunks(conversations: DataFrame) -> DataFrame:
        """Each turn in chunks of ten words with three of the chunk before, as a live recording sends them; works on streams."""
        size = F.size("t")
        turns = conversations.select(
            F.col("conv_id").alias("recording_id"), F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("channel_id"), "turn",
            F.filter(F.split("text", r"[ \t\n\r]+"), lambda t: t != "").alias("t"),
        )
        k = turns.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - 10) / 10)).cast("int"))))
        first = F.when(F.col("k") == 0, 0).otherwise(10 * F.col("k") - 3)
        marked = lambda x, i: F.when((i + F.col("turn")) % 23 == 22, "[BLANK_AUDIO]").when((i + F.col("k")) % 29 == 28, "[MUSIC]").otherwise(F.concat(F.lit(" "), x))
        # a pause of a second after the sixth word of every other chunk
        begin = lambda i: (i * 500 + F.when((i >= 6) & (F.col("k") % 2 == 1), 1000).otherwise(0)) / 1000.0
        word = F.transform(F.slice("t", first + 1, 10 * F.col("k") + 10 - first), lambda x, i: F.struct(i.alias("pos"), marked(x, i).alias("text"), begin(i).alias("start"), (begin(i) + 0.45).alias("end")))
        index = (F.col("turn") * 10_000 + F.col("k")).cast("long")
        return k.select("recording_id", "channel_id", index.alias("chunk_index"), F.when(F.col("k") == 0, 0.0).otherwise(1.5).alias("overlap"), F.lit(False).alias("is_final"), word.alias("words"))

    @staticmethod
    def letter_voices(phrases: DataFrame) -> DataFrame:
        """Adds an embedding made of a phrase's letters, none for some; without state, so that it works on streams."""
        text = F.lower(F.array_join(F.transform("words", lambda w: F.coalesce(w["text"], F.lit(""))), ""))
        count = F.transform(F.array(*[F.lit(c) for c in "aeinorst"]), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit(""))) + 0.25).cast("double"))
        return phrases.withColumn("embedding", F.when(F.col("phrase_id").isNotNull() & (F.length(text) % 7 != 6), count))

    @cached_property
    def voices(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.floor(F.col("vec_id") / 25).alias("recording_id"), F.col("vec_id").alias("ord"), F.col("label"), V.doubles(F.col("embedding")).alias("embedding"))

    @cached_property
    def n_voices(self) -> int:
        """How many voices there are, 1 at least; from the file's own counts."""
        return max(1, self.table("embeddings").count())

    @cached_property
    def samples(self) -> DataFrame:
        """Enrollment samples: one enrollment a label."""
        return self.table("embeddings").select(F.col("label").alias("enrollment_id"), F.col("vec_id").alias("sample_id"), V.doubles(F.col("embedding")).alias("embedding"))

    @cached_property
    def roster(self) -> DataFrame:
        """One enrollment a label; centroid of its normalised samples."""
        mean = V.mean_vector(self.samples.withColumn("u", V.l2_normalize(F.col("embedding"))), ["enrollment_id"], "u", "m")
        model = F.when(F.col("enrollment_id") < 5, "m0").otherwise("m1")
        return mean.select("enrollment_id", F.concat(F.lit("S"), F.col("enrollment_id").cast("string")).alias("name"), model.alias("model_id"), V.l2_normalize(F.col("m")).alias("centroid"))

    @cached_property
    def segments(self) -> DataFrame:
        e, order = self.table("events"), Window.partitionBy("user_id").orderBy("ts", "event_id")
        begin = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        return e.select(
            F.col("user_id").alias("recording_id"), (F.row_number().over(order) - 1).alias("segment_index"), F.round(begin, 3).alias("start"), (F.round(begin, 3) + 60 * F.col("value")).alias("end"),
            F.col("event_type").alias("speaker"), (F.col("value") / 500).alias("confidence"), (F.col("event_id") % self.n_voices).alias("vec_id"), "event_id",
        )

    @cached_property
    def event_words(self) -> DataFrame:
        """Events as words of 30 seconds, to be mapped to the segments of the same recording."""
        return self.segments.select("recording_id", F.col("segment_index").alias("pos"), "start", (F.col("start") + 30).alias("end"), F.col("speaker").alias("text"))

    @cached_property
    def seg_spans(self) -> DataFrame:
        return self.segments.select("recording_id", F.col("segment_index").alias("seg_id"), "start", "end", "speaker", "confidence")

    @cached_property
    def frame_logits(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        logits = F.array(*[((F.col("event_id") * (j + 1)) % 11) / 2.0 for j in range(7)])
        return self.table("events").select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).alias("frame"), logits.alias("logits"))

    @cached_property
    def frames(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        feat = F.array("l_quantity", F.col("l_extendedprice") / 1e4, "l_discount", "l_tax")
        return self.table("lineitem").select(F.col("l_orderkey").alias("clip"), (F.row_number().over(order) - 1).alias("frame"), feat.alias("feat"))

    @cached_property
    def recordings(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("duration"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def logs(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("log_id"), "ts", F.col("event_type").alias("type"), F.col("props").alias("data"), "value")


def sample_scorer():
    """Stands in for a voice model in the queries: mean, spread and length of the samples, for which the tables hold no model."""

    def score(samples):
        n, mean = len(samples), sum(samples) / max(1, len(samples))
        return None if n == 0 else [mean, sum((x - mean) ** 2 for x in samples) / n, n / 10]

    return score


SQL = {
    "words": r"""
        SELECT recording_id, channel_id, chunk_index, pos, text, (400 * pos + 500 * brk) / CAST(1000 AS DOUBLE) AS "start", (400 * pos + 500 * brk + 350) / CAST(1000 AS DOUBLE) AS "end"
        FROM (SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS brk
              FROM (SELECT conv_id AS recording_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS channel_id, turn AS chunk_index, t[i] AS text, i - 1 AS pos
                    FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS t FROM conversations))))""",
    "marked_words": """
        SELECT * REPLACE (CASE WHEN pos % 17 = 0 THEN '[BLANK_AUDIO]' WHEN pos % 13 = 0 THEN '[MUSIC]' WHEN pos % 11 = 0 THEN '(laughs)' ELSE text END AS text) FROM words""",
    "overlap_words": r"""
        SELECT recording_id, chunk_index, overlap, i - f - 1 AS pos, t[i] AS text, (i - f - 1) * 500 / CAST(1000 AS DOUBLE) AS "start", (i - f) * 500 / CAST(1000 AS DOUBLE) AS "end"
        FROM (SELECT *, unnest(range(f + 1, least(10 * chunk_index + 10, len(t)) + 1)) AS i
              FROM (SELECT recording_id, k AS chunk_index, t, CASE WHEN k = 0 THEN 0 ELSE 10 * k - 3 END AS f, CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS overlap
                    FROM (SELECT recording_id, t, unnest(range(0, 1 + CAST(greatest(0, ceil((len(t) - 10) / 10)) AS BIGINT))) AS k
                          FROM (SELECT doc_id AS recording_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 0)))""",
    "voices": "SELECT vec_id // 25 AS recording_id, vec_id AS ord, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "samples": "SELECT label AS enrollment_id, vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "roster": """
        SELECT enrollment_id, 'S' || enrollment_id AS name, CASE WHEN enrollment_id < 5 THEN 'm0' ELSE 'm1' END AS model_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid
        FROM (SELECT enrollment_id, list(a ORDER BY i) AS m FROM (SELECT enrollment_id, i, avg(u[i]) AS a
              FROM (SELECT enrollment_id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u, unnest(range(1, len(embedding) + 1)) AS i FROM samples)
              GROUP BY enrollment_id, i) GROUP BY enrollment_id)""",
    "segments": """
        SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS segment_index, round(epoch_us(ts) / 1e6, 3) AS "start", round(epoch_us(ts) / 1e6, 3) + 60 * value AS "end",
               event_type AS speaker, value / 500 AS confidence, event_id % (SELECT greatest(1, count(*)) FROM embeddings) AS vec_id, event_id FROM events""",
    "frame_logits": """
        SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, list_transform([1, 2, 3, 4, 5, 6, 7], lambda j: ((event_id * j) % 11) / CAST(2 AS DOUBLE)) AS logits FROM events""",
    "frames": """
        SELECT l_orderkey AS clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS frame, [l_quantity, l_extendedprice / 1e4, l_discount, l_tax] AS feat FROM lineitem""",
    "recordings": "SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status, o_totalprice AS duration, o_orderdate AS created_at FROM orders",
    "logs": "SELECT user_id AS session_id, event_id AS log_id, ts, event_type AS type, props AS data, value FROM events",
    "event_words": """SELECT recording_id, segment_index AS pos, "start", "start" + 30 AS "end", speaker AS text FROM segments""",
    "mapped_words": """
        SELECT w.*, s.speaker, CASE WHEN s.recording_id IS NULL THEN 0 ELSE coalesce(nullif(s.confidence, 0), 1) END AS confidence
        FROM event_words w LEFT JOIN segments s ON w.recording_id = s.recording_id AND s."start" <= (w."start" + w."end") / 2 AND (w."start" + w."end") / 2 < s."end"
        QUALIFY row_number() OVER (PARTITION BY w.recording_id, w.pos ORDER BY s."start", s.segment_index) = 1""",
    "speaker_runs": """
        SELECT recording_id, phrase_id, min_by("start", pos) AS "start", max_by("end", pos) AS "end", any_value(speaker) AS speaker, count(*) AS n_words, avg(confidence) AS avg_confidence
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY recording_id ORDER BY pos) AS BIGINT) AS phrase_id FROM (SELECT *, CASE WHEN pos > 0 AND speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY recording_id ORDER BY pos) THEN 1 ELSE 0 END AS n FROM mapped_words))
        GROUP BY recording_id, phrase_id""",
    "phrases": """
        SELECT recording_id, channel_id, chunk_index, phrase_id, min_by("start", pos) AS "start", max_by("end", pos) AS "end", count(*) AS n_words, string_agg(text, '' ORDER BY pos) AS text
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY recording_id, chunk_index ORDER BY pos) AS BIGINT) AS phrase_id
              FROM (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY recording_id, chunk_index ORDER BY pos) >= 0.2 THEN 1 ELSE 0 END AS n FROM words))
        GROUP BY recording_id, channel_id, chunk_index, phrase_id""",
    "ranked": """
        SELECT v.ord, v.recording_id, r.enrollment_id AS idx, r.name, list_cosine_similarity(v.embedding, r.centroid) AS similarity, row_number() OVER (PARTITION BY v.ord ORDER BY list_cosine_similarity(v.embedding, r.centroid) DESC, r.enrollment_id) AS rank
        FROM voices v, roster r""",
    "assigned": """
        SELECT ord, recording_id, similarity, margin, CAST(CASE WHEN similarity >= 0.2 AND margin >= 0.02 THEN idx ELSE -1 END AS INTEGER) AS speaker_id, CASE WHEN similarity >= 0.2 AND margin >= 0.02 THEN name ELSE 'Unknown' END AS speaker_label,
               CASE WHEN similarity >= 0.2 AND margin < 0.02 THEN 'ambiguous_match' WHEN similarity >= 0.2 THEN 'confident_match' WHEN similarity < 0.1 THEN 'below_minimum_threshold' ELSE 'no_confident_match' END AS reason
        FROM (SELECT *, similarity - lead(similarity) OVER (PARTITION BY ord ORDER BY rank) AS margin FROM ranked) WHERE rank = 1""",
}
#: The same against another roster: without its first enrollment.
SQL["other_roster"] = "SELECT * FROM roster WHERE enrollment_id <> 0"
SQL["other_ranked"] = SQL["ranked"].replace("roster r", "other_roster r")
SQL["other_assigned"] = SQL["assigned"].replace("FROM ranked", "FROM other_ranked")
