"""Phrases, runs, interval joins and overlap over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxspark.functions import text as X
from voxspark.functions import vectors as V
from voxspark.operators import overlap as O
from voxspark.operators import phrases as P
from voxspark.plans.q_text import NORM, TRIMMED
from voxspark.plans.registry import query

CHUNK = ["recording_id", "channel_id", "chunk_index"]
R6 = lambda *names: {n: F.round(n, 6) for n in names}


@query("E3_detect_phrases", """SELECT recording_id, channel_id, chunk_index, phrase_id, round("start", 6) AS "start", round("end", 6) AS "end", n_words FROM phrases""")
def _(t):
    return P.detect_phrases(t.words, CHUNK).drop("words").withColumns(R6("start", "end"))


@query("A21_join_text", f"SELECT recording_id, channel_id, chunk_index, phrase_id, {TRIMMED} AS text FROM phrases")
def _(t):
    return P.detect_phrases(t.words, CHUNK).select(*CHUNK, "phrase_id", P.join_text(F.col("words")).alias("text"))


@query(
    "P9_drop_unusable_phrases",
    rf"""SELECT recording_id, chunk_index, phrase_id, n_words FROM (
            SELECT recording_id, chunk_index, phrase_id, count(*) AS n_words, bool_or(trim(regexp_replace(text, '\[BLANK[_\s]*AUDIO\]', '', 'gi'), {X.WHITE_SQL}) <> '') AS filled, min_by("start", pos) AS s, max_by("end", pos) AS e
            FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY recording_id, chunk_index ORDER BY pos) AS BIGINT) AS phrase_id
                  FROM (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY recording_id, chunk_index ORDER BY pos) >= 0.05 AND pos % 17 IN (0, 1) THEN 1 WHEN "start" - lag("end") OVER (PARTITION BY recording_id, chunk_index ORDER BY pos) >= 0.2 THEN 1 ELSE 0 END AS n FROM marked_words)) GROUP BY ALL)
        WHERE filled AND e > s AND NOT (phrase_id = 0)""",
)
def _(t):
    order = Window.partitionBy("recording_id", "chunk_index").orderBy("pos")
    gap = F.col("start") - F.lag("end").over(order)
    new = F.when((gap >= 0.05) & (F.col("pos") % 17).isin(0, 1), 1).when(gap >= 0.2, 1).otherwise(0)
    rows = t.marked_words.withColumn("n", new).withColumn("phrase_id", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    phrases = rows.groupBy("recording_id", "chunk_index", "phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end"))).alias("words"))
    phrases = phrases.withColumns({"start": F.element_at("words", 1)["start"], "end": F.element_at("words", -1)["end"], "embedding": F.lit(None).cast("array<double>"), "reason": F.when(F.col("phrase_id") == 0, "inherited")})
    return P.drop_unusable(phrases).select("recording_id", "chunk_index", "phrase_id", F.size("words").cast("long").alias("n_words"))


@query("J2_map_words_to_segments", "SELECT recording_id, pos, speaker, round(confidence, 6) AS confidence FROM mapped_words")
def _(t):
    return P.map_words_to_segments(t.event_words, t.seg_spans, ["recording_id"], 7200.0).select("recording_id", "pos", "speaker", F.round("confidence", 6).alias("confidence"))


def runs(t):
    return P.group_by_speaker_run(P.map_words_to_segments(t.event_words, t.seg_spans, ["recording_id"], 7200.0), ["recording_id"])


@query("E4_group_by_speaker_run", """SELECT recording_id, phrase_id, round("start", 3) AS "start", round("end", 3) AS "end", speaker, n_words FROM speaker_runs""")
def _(t):
    return runs(t).select("recording_id", "phrase_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker", "n_words")


@query("A22_avg_confidence", "SELECT recording_id, phrase_id, round(avg_confidence, 6) AS avg_confidence FROM speaker_runs")
def _(t):
    return runs(t).select("recording_id", "phrase_id", F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    "E5_absorb_short_phrases",
    """WITH m AS (SELECT *, sum(CASE WHEN phrase_id = 0 OR "end" - "start" >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY phrase_id) AS island FROM speaker_runs),
       w AS (SELECT *, n_words > coalesce(sum(n_words) OVER (PARTITION BY recording_id, island ORDER BY phrase_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM m)
       SELECT recording_id, min(phrase_id) AS phrase_id, round(min_by("start", phrase_id), 3) AS "start", round(max_by("end", phrase_id), 3) AS "end", arg_max_null(speaker, CASE WHEN wins THEN phrase_id END) AS speaker, CAST(sum(n_words) AS BIGINT) AS n_words FROM w GROUP BY recording_id, island""",
)
def _(t):
    out = P.absorb_short_phrases(runs(t), ["recording_id"], 3600.0)
    return out.select("recording_id", "phrase_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker", "n_words")


@query(
    "E6_merge_same_speaker",
    """WITH r AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY "start", segment_index) AS run FROM (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY recording_id ORDER BY "start", segment_index) THEN 0 ELSE 1 END AS b FROM segments)),
       i AS (SELECT *, sum(g) OVER (PARTITION BY recording_id, run ORDER BY "start", segment_index) AS island FROM (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY recording_id, run ORDER BY "start", segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3600 THEN 1 ELSE 0 END AS g FROM r)),
       k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, run, island ORDER BY "start", segment_index) AS i, count(*) OVER (PARTITION BY recording_id, run, island) AS n FROM i)
       SELECT recording_id, round(min("start"), 3) AS "start", round(max("end"), 3) AS "end", any_value(speaker) AS speaker, round(sum(confidence * pow(CAST(2 AS DOUBLE), -(CASE WHEN i = 1 THEN n - 1 ELSE n - i + 1 END))), 6) AS confidence, count(*) AS n
       FROM k GROUP BY recording_id, run, island""",
)
def _(t):
    return P.merge_same_speaker(t.seg_spans, ["recording_id"], 3600.0).withColumns({"start": F.round("start", 3), "end": F.round("end", 3), "confidence": F.round("confidence", 6)})


@query("P10_filter_segments", """SELECT recording_id, segment_index AS seg_id, speaker FROM segments WHERE confidence >= 0.05 AND "end" - "start" >= 600""")
def _(t):
    return P.filter_segments(t.seg_spans, 0.05, 600.0).select("recording_id", "seg_id", "speaker")


@query(
    "P11_pad_segments",
    """SELECT recording_id, segment_index AS seg_id, round(greatest(0, "start" - b - 100), 3) AS "start", round(least(86400, "end" - b + 100), 3) AS "end" FROM (SELECT *, min("start") OVER (PARTITION BY recording_id) AS b FROM segments)""",
)
def _(t):
    first = F.min("start").over(Window.partitionBy("recording_id"))
    rel = t.seg_spans.withColumn("b", first).withColumns({"start": F.col("start") - F.col("b"), "end": F.col("end") - F.col("b")})
    return P.pad_segments(rel, 100.0, F.lit(86400.0)).select("recording_id", "seg_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("P12_adjust_timestamps", """SELECT recording_id, chunk_index, pos, round(greatest(0, "start" - overlap), 6) AS "start", round(greatest(0, "end" - overlap), 6) AS "end" FROM overlap_words""")
def _(t):
    words = t.overlap_chunks.select("recording_id", "chunk_index", "overlap", F.inline("words"))
    return P.adjust_timestamps(words, F.col("overlap")).select("recording_id", "chunk_index", "pos", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "P13_overlap_tail_head",
    """SELECT recording_id, chunk_index, count(*) FILTER (WHERE "start" >= last_end - 1.5) AS n_tail, count(*) FILTER (WHERE "start" < 1.5) AS n_head, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE "start" >= last_end - 1.5), '') AS tail
       FROM (SELECT *, max_by("end", pos) OVER (PARTITION BY recording_id, chunk_index) AS last_end FROM overlap_words) GROUP BY ALL""",
)
def _(t):
    tail, head = O.overlap_tail(F.col("words"), F.lit(1.5)), O.overlap_head(F.col("words"), F.lit(1.5))
    return t.overlap_chunks.select("recording_id", "chunk_index", F.size(tail).cast("long").alias("n_tail"), F.size(head).cast("long").alias("n_head"), F.array_join(F.transform(tail, lambda w: w["text"]), " ").alias("tail"))


def with_previous(t):
    return O.previous_chunk(t.overlap_chunks, ["recording_id"], ["chunk_index"])


@query("J13_previous_chunk", "SELECT recording_id, chunk_index, lag(n) OVER (PARTITION BY recording_id ORDER BY chunk_index) AS n_previous FROM (SELECT recording_id, chunk_index, count(*) AS n FROM overlap_words GROUP BY ALL)")
def _(t):
    return with_previous(t).select("recording_id", "chunk_index", F.when(F.col("prev_words").isNotNull(), F.size("prev_words")).cast("long").alias("n_previous"))


J5 = f"""
    WITH c AS (SELECT recording_id, chunk_index, any_value(overlap) AS overlap, list({NORM} ORDER BY pos) AS n, list(text ORDER BY pos) AS x, list("start" ORDER BY pos) AS s, list("end" ORDER BY pos) AS e FROM overlap_words GROUP BY ALL),
    p AS (SELECT *, lag(n) OVER w AS pn, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY chunk_index)),
    z AS (SELECT *, [pn[k] for k in range(1, coalesce(len(pn), 0) + 1) if ps[k] >= pe[len(pe)] - overlap] AS t, [n[k] for k in range(1, len(n) + 1) if s[k] < overlap] AS h FROM p),
    i AS (SELECT recording_id, chunk_index, t, h, w, i, unnest(range(0, len(h) - w + 1)) AS j FROM (SELECT *, unnest(range(0, len(t) - w + 1)) AS i FROM (SELECT *, unnest(range(2, least(len(t), len(h)) + 1)) AS w FROM z WHERE pn IS NOT NULL AND overlap > 0))),
    q AS (SELECT recording_id, chunk_index, w, i, j, sum(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0 WHEN contains(a, b) OR contains(b, a) OR 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) >= 0.75 THEN 0.8 ELSE 0 END) / CAST(w AS DOUBLE) AS sim
          FROM (SELECT *, t[i + k + 1] AS a, h[j + k + 1] AS b FROM (SELECT *, unnest(range(0, w)) AS k FROM i)) GROUP BY recording_id, chunk_index, w, i, j),
    b AS (SELECT * FROM q WHERE sim >= 0.8 - 1e-12 QUALIFY row_number() OVER (PARTITION BY recording_id, chunk_index ORDER BY w DESC, sim DESC, i, j) = 1)
    SELECT p.recording_id, p.chunk_index, CAST(CASE WHEN b.w IS NULL THEN 0 ELSE [k for k in range(1, len(x) + 1) if x[k] = x[b.j + b.w] and abs(s[k] - s[b.j + b.w]) < 0.1][1] END AS INTEGER) AS merge_index,
           round(CASE WHEN pn IS NULL OR p.overlap <= 0 THEN 1 WHEN b.w IS NULL THEN 0 ELSE b.sim END, 6) AS merge_confidence, CASE WHEN pn IS NULL OR p.overlap <= 0 THEN 'no_overlap' WHEN b.w IS NULL THEN 'no_text_match' ELSE 'text_match' END AS method,
           round(CASE WHEN pn IS NULL OR p.overlap <= 0 THEN NULL WHEN b.w IS NULL THEN p.overlap ELSE coalesce(nullif(e[b.j + b.w], 0), p.overlap) END, 6) AS merge_time
    FROM p LEFT JOIN b ON p.recording_id = b.recording_id AND p.chunk_index = b.chunk_index"""


@query("J5_align_overlap", J5)
def _(t):
    return O.align_overlap(with_previous(t)).select("recording_id", "chunk_index", "merge_index", F.round("merge_confidence", 6).alias("merge_confidence"), "method", F.round("merge_time", 6).alias("merge_time"))


@query(
    "C13_single_word_dedup",
    f"""WITH c AS (SELECT recording_id, chunk_index, min_by({NORM}, pos) AS f, max_by({NORM}, pos) AS l, min_by("end", pos) AS fe, count(*) AS n FROM overlap_words GROUP BY ALL),
        p AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY recording_id ORDER BY chunk_index) = f AND f <> '', false) AS same FROM c)
        SELECT recording_id, chunk_index, CASE WHEN same THEN 'single_word_dedup' END AS method, CASE WHEN same THEN fe END AS cut_time, n - CAST(same AS INTEGER) AS n_words FROM p""",
)
def _(t):
    return O.single_word_dedup(with_previous(t)).select("recording_id", "chunk_index", "method", "cut_time", F.size("words").cast("long").alias("n_words"))


@query(
    "P14_trim_phrases_at_merge",
    """WITH p AS (SELECT recording_id, chunk_index, phrase_id, "start", "end", CAST(4 * (chunk_index % 5) AS DOUBLE) AS m, CAST(1.5 AS DOUBLE) AS o FROM phrases),
       s AS (SELECT *, count(*) FILTER (WHERE "start" >= m) OVER (PARTITION BY recording_id, chunk_index) AS k FROM p)
       SELECT recording_id, chunk_index, phrase_id, round(CASE WHEN k > 0 THEN "start" ELSE greatest(0, "start" - o) END, 6) AS "start", round(CASE WHEN k > 0 THEN "end" ELSE "end" - o END, 6) AS "end"
       FROM s WHERE CASE WHEN k > 0 THEN "start" >= m ELSE "end" > m END""",
)
def _(t):
    rows = P.detect_phrases(t.words, CHUNK).withColumns({"merge_time": (4 * (F.col("chunk_index") % 5)).cast("double"), "overlap": F.lit(1.5)})
    return O.trim_phrases_at_merge(rows, CHUNK).select("recording_id", "chunk_index", "phrase_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "P15_embedding_gate",
    """SELECT recording_id, chunk_index, phrase_id, CASE WHEN channel_id = 1 AND recording_id % 2 = 0 THEN 'skipped_single_speaker' WHEN "end" - "start" < 0.5 OR ceil("end" * 16000) - floor("start" * 16000) < 8000 THEN 'too_short' END AS reason FROM phrases""",
)
def _(t):
    expected = F.when((F.col("channel_id") == 1) & (F.col("recording_id") % 2 == 0), 1).otherwise(2)
    return P.embedding_gate(P.detect_phrases(t.words, CHUNK), expected).select("recording_id", "chunk_index", "phrase_id", "reason")


@query(
    "E9_channel_time_offset",
    """SELECT recording_id, channel_id, chunk_index, round(coalesce(sum(greatest(0, d - CASE WHEN chunk_index > 1 THEN 1.5 ELSE 0 END)) OVER (PARTITION BY recording_id, channel_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS time_offset
       FROM (SELECT recording_id, channel_id, chunk_index, max("end") AS d FROM words GROUP BY ALL)""",
)
def _(t):
    chunks = t.words.groupBy(*CHUNK).agg(F.max("end").alias("duration")).withColumn("overlap", F.when(F.col("chunk_index") > 1, 1.5).otherwise(0.0))
    return O.channel_time_offset(chunks, ["recording_id", "channel_id"], ["chunk_index"]).select(*CHUNK, F.round("time_offset", 6).alias("time_offset"))


SOFT = "list_transform(logits, lambda x: exp(x - list_max(logits)) / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))"


@query("H13_softmax", f"SELECT clip, frame, list_transform({SOFT}, lambda x: round(x, 6)) AS p FROM frame_logits")
def _(t):
    return t.frame_logits.select("clip", "frame", F.transform(V.softmax(F.col("logits")), lambda x: F.round(x, 6)).alias("p"))


@query("H14_argmax", "SELECT clip, frame, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS top FROM frame_logits")
def _(t):
    return t.frame_logits.select("clip", "frame", V.argmax(F.col("logits")).alias("top"))


@query("H18_powerset_speakers", "SELECT clip, frame, [[], [0], [1], [2], [0, 1], [0, 2], [1, 2]][list_position(logits, list_max(logits))] AS speakers FROM frame_logits")
def _(t):
    return t.frame_logits.select("clip", "frame", V.powerset_speakers(V.argmax(F.col("logits"))).alias("speakers"))


@query(
    "E10_decode_frames",
    f"""WITH p AS (SELECT clip, frame, [[], [0], [1], [2], [0, 1], [0, 2], [1, 2]][list_position(logits, list_max(logits))] AS k, list_max({SOFT}) AS p FROM frame_logits),
        a AS (SELECT clip, frame, p, unnest(k) AS speaker FROM p), r AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, speaker ORDER BY frame) AS run FROM a)
        SELECT clip, speaker, round((990 + 270 * min(frame)) / CAST(16000 AS DOUBLE), 6) AS "start", round((990 + 270 * (max(frame) + 1)) / CAST(16000 AS DOUBLE), 6) AS "end", round(avg(p), 6) AS confidence FROM r GROUP BY clip, speaker, run""",
)
def _(t):
    return P.decode_frames(t.frame_logits, "clip").withColumns(R6("start", "end", "confidence"))


@query("A20_segments_per_speaker", "SELECT recording_id, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers FROM segments GROUP BY recording_id")
def _(t):
    return t.seg_spans.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("speaker").alias("n_speakers"))


@query(
    "J3_pool_frames",
    """WITH ph AS (SELECT DISTINCT clip, k AS phrase_id, k * 0.4 AS "start", k * 0.4 + CASE WHEN k = 1 THEN 0.3 ELSE 0.9 END AS "end" FROM frames, (SELECT unnest([0, 1, 2, 3]) AS k)),
       c AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip),
       b AS (SELECT ph.*, floor("start" * (n / CAST(2 AS DOUBLE))) AS lo, least(ceil("end" * (n / CAST(2 AS DOUBLE))), n) AS hi FROM ph JOIN c USING (clip))
       SELECT b.clip, phrase_id, CASE WHEN any_value("end" - "start") < 0.5 THEN 'too_short' WHEN any_value(hi) <= any_value(lo) THEN 'no_frames' END AS reason, CAST(greatest(0, any_value(hi - lo)) AS BIGINT) AS frame_count,
              CASE WHEN any_value("end" - "start") >= 0.5 AND any_value(hi) > any_value(lo) THEN [round(avg(feat[1]), 9), round(avg(feat[2]), 9), round(avg(feat[3]), 9), round(avg(feat[4]), 9)] END AS embedding
       FROM b LEFT JOIN frames f ON f.clip = b.clip AND f.frame >= lo AND f.frame < hi GROUP BY b.clip, phrase_id""",
)
def _(t):
    k = F.col("phrase_id")
    clips = t.frames.select("clip").distinct().withColumn("phrase_id", F.explode(F.array(*map(F.lit, range(4)))))
    phrases = clips.select("clip", "phrase_id", (k * 0.4).alias("start"), (k * 0.4 + F.when(k == 1, 0.3).otherwise(0.9)).alias("end"))
    out = P.pool_frames(phrases, t.frames, ["clip"], 2.0)
    return out.select("clip", "phrase_id", "reason", "frame_count", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))
