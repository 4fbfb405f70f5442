"""Predicates and scalar functions over the bound words."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxspark.functions import text as X
from voxspark.plans.registry import query

STEMS = "|".join(X.HUMAN_STEMS)
TRIMMED = f"trim(text, {X.WHITE_SQL})"
BRACKETED = rf"regexp_full_match({TRIMMED}, '\[[^\n\r]*\]|\([^\n\r]*\)')"
HUMAN = f"regexp_matches(lower(text), '{STEMS}')"
BLANK = f"(starts_with(upper({TRIMMED}), '[BLANK') OR upper({TRIMMED}) = 'AUDIO]')"
NORM = rf"trim(regexp_replace(lower(text), '[^a-zA-Z0-9_\s]', '', 'g'), {X.WHITE_SQL})"
ENV = f"({BRACKETED} AND NOT {HUMAN})"
KEYS = ["recording_id", "chunk_index", "pos"]


def _per_word(name: str, column, sql: str) -> None:
    query(name, f"SELECT recording_id, chunk_index, pos, {sql} AS v FROM marked_words")(lambda t: t.marked_words.select(*KEYS, column(F.col("text")).alias("v")))


_per_word("P1_is_bracketed_marker", X.is_bracketed_marker, BRACKETED)
_per_word("P2_is_human_voice", X.is_human_voice, HUMAN)
_per_word("P3_is_environmental", X.is_environmental, ENV)
_per_word("P4_is_blank_audio", X.is_blank_audio, BLANK)
_per_word("P5_classify_sound", X.classify_sound, f"CASE WHEN {TRIMMED} = '' OR {BLANK} THEN 'blank' WHEN NOT {BRACKETED} THEN 'speech' WHEN {HUMAN} THEN 'human_voice' ELSE 'environmental' END")
_per_word("H4_normalize_word", X.normalize_word, NORM)


@query(
    "P6_categorize_phrase",
    f"""SELECT recording_id, chunk_index, pos % 17 AS part, CASE WHEN bool_and({BLANK}) THEN 'blank' WHEN bool_and({ENV}) THEN 'environmental' ELSE 'speech' END AS kind, count(*) AS n_words
        FROM marked_words GROUP BY ALL""",
)
def _(t):
    rows = t.marked_words.groupBy("recording_id", "chunk_index", (F.col("pos") % 17).alias("part")).agg(F.collect_list("text").alias("texts"))
    return rows.select("recording_id", "chunk_index", "part", X.categorize_phrase(F.col("texts")).alias("kind"), F.size("texts").cast("long").alias("n_words"))


@query(
    "P7_strip_blank_markers",
    rf"""SELECT recording_id, chunk_index, trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '\[BLANK[_\s]*AUDIO\]', '', 'gi'), {X.WHITE_SQL}) AS text FROM marked_words GROUP BY ALL""",
)
def _(t):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    return t.marked_words.groupBy("recording_id", "chunk_index").agg(X.strip_blank_markers(joined).alias("text"))


@query(
    "P8_is_effectively_empty",
    r"""SELECT recording_id, chunk_index, pos % 17 AS part, bool_and(regexp_replace(upper(text), '[\s_]', '', 'g') = '[BLANKAUDIO]') AS is_empty FROM marked_words GROUP BY ALL""",
)
def _(t):
    rows = t.marked_words.groupBy("recording_id", "chunk_index", (F.col("pos") % 17).alias("part")).agg(F.collect_list("text").alias("texts"))
    return rows.select("recording_id", "chunk_index", "part", X.is_effectively_empty(F.col("texts")).alias("is_empty"))


PAIRED = f"SELECT recording_id, chunk_index, pos, {NORM} AS a, lead({NORM}) OVER (PARTITION BY recording_id, chunk_index ORDER BY pos) AS b FROM words"
FUZZY = "CASE WHEN a = '' OR b = '' THEN false ELSE contains(a, b) OR contains(b, a) OR 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) >= 0.75 END"


def _pairs(t):
    from pyspark.sql import Window

    return t.words.select(*KEYS, X.normalize_word(F.col("text")).alias("a")).withColumn("b", F.lead("a").over(Window.partitionBy("recording_id", "chunk_index").orderBy("pos"))).where("b IS NOT NULL")


@query("H5_levenshtein", f"SELECT recording_id, chunk_index, pos, levenshtein(strip_accents(a), strip_accents(b)) AS d FROM ({PAIRED}) WHERE b IS NOT NULL")
def _(t):
    return _pairs(t).select(*KEYS, F.levenshtein("a", "b").alias("d"))


@query("H6_fuzzy_match", f"SELECT recording_id, chunk_index, pos, {FUZZY} AS alike FROM ({PAIRED}) WHERE b IS NOT NULL")
def _(t):
    return _pairs(t).select(*KEYS, X.fuzzy_match(F.col("a"), F.col("b")).alias("alike"))


@query(
    "H7_sequence_similarity",
    f"""SELECT recording_id, chunk_index, pos // 4 AS part, round(sum(CASE WHEN a = b THEN 1.0 WHEN {FUZZY} THEN 0.8 ELSE 0 END) / count(*), 6) AS similarity FROM ({PAIRED}) WHERE b IS NOT NULL GROUP BY ALL""",
)
def _(t):
    rows = _pairs(t).groupBy("recording_id", "chunk_index", F.floor(F.col("pos") / 4).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("w"))
    a, b = F.transform("w", lambda s: s["a"]), F.transform("w", lambda s: s["b"])
    return rows.select("recording_id", "chunk_index", "part", F.round(X.sequence_similarity(a, b), 6).alias("similarity"))


@query("H8_tokenize", r"SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS tokens FROM conversations")
def _(t):
    return t.table("conversations").select("conv_id", "turn", X.tokenize(F.col("text")).alias("tokens"))


@query("H9_is_word_duplicate", f"SELECT recording_id, chunk_index, pos, a = b AND a <> '' AS same FROM ({PAIRED}) WHERE b IS NOT NULL")
def _(t):
    return _pairs(t).select(*KEYS, X.is_word_duplicate(F.col("a"), F.col("b")).alias("same"))


@query(
    "H10_format_time",
    """SELECT id, CAST(floor(floor(duration) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS short,
              CASE WHEN floor(duration) >= 3600 THEN CAST(floor(floor(duration) / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor(floor(duration) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0')
                   ELSE CAST(floor(floor(duration) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS long,
              CASE WHEN id < 1024 THEN id || ' B' WHEN id < 1048576 THEN format('{:.1f}', round(id / CAST(1024 AS DOUBLE), 1)) || ' KB' ELSE format('{:.1f}', round(id / CAST(1048576 AS DOUBLE), 1)) || ' MB' END AS size
       FROM recordings""",
)
def _(t):
    d = F.col("duration")
    return t.recordings.select("id", X.format_time(d).alias("short"), X.format_duration(d).alias("long"), X.format_size(F.col("id")).alias("size"))


@query(
    "P16_is_unknown_id",
    "SELECT ord, id, id <= -100 AS unknown, id <= -100 OR id = -1 AS shown FROM (SELECT ord, CASE WHEN ord % 3 = 0 THEN -1 WHEN ord % 3 = 1 THEN -100 - ord % 5 ELSE ord % 7 END AS id FROM voices)",
)
def _(t):
    i, o = F.col("id"), F.col("ord")
    ids = t.voices.select("ord", F.when(o % 3 == 0, F.lit(-1)).when(o % 3 == 1, -100 - o % 5).otherwise(o % 7).alias("id"))
    return ids.select("ord", "id", X.is_unknown_id(i).alias("unknown"), X.is_unknown_id(i, True).alias("shown"))


@query(
    "P17_speaker_label",
    """SELECT ord, CASE WHEN id = -1 THEN 'Unknown' WHEN id <= -100 THEN 'Unknown ' || (-100 - id + 1) WHEN name IS NOT NULL THEN name ELSE 'Speaker ' || (id + 1) END AS label
       FROM (SELECT ord, CASE WHEN ord % 3 = 0 THEN -1 WHEN ord % 3 = 1 THEN -100 - ord % 5 ELSE ord % 7 END AS id, CASE WHEN ord % 7 < 4 THEN 'S' || (ord % 7) END AS name FROM voices)""",
)
def _(t):
    o = F.col("ord")
    ids = t.voices.select("ord", F.when(o % 3 == 0, F.lit(-1)).when(o % 3 == 1, -100 - o % 5).otherwise(o % 7).alias("id"), F.when(o % 7 < 4, F.concat(F.lit("S"), (o % 7).cast("string"))).alias("name"))
    return ids.select("ord", X.speaker_label(F.col("id"), F.col("name")).alias("label"))
