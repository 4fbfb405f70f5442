"""Text predicates and scalar functions; everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stems of sounds that a person makes.
HUMAN_STEMS = [
    "laugh", "chuckle", "giggle", "cough", "sigh", "sneeze", "cry", "sob",
    "scream", "groan", "moan", "yawn", "gasp", "breath", "hum", "whistle",
    "sing", "clear", "throat", "hiccup", "snore", "sniff", "whimper",
]


#: What counts as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as a DuckDB expression.
WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE)


def trim(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def is_bracketed_marker(text: Column) -> Column:
    """The trimmed text is one [...] or (...) without a line break inside."""
    closed = text.contains("]") | text.contains(")")  # a cheap look first, as most words have neither
    return F.coalesce(closed & trim(text).rlike(r"\A(?:\[[^\n\r]*\]|\([^\n\r]*\))\z"), F.lit(False))


def is_human_voice(text: Column) -> Column:
    """The text contains a stem of a human sound, anywhere."""
    return F.coalesce(F.lower(text).rlike("|".join(HUMAN_STEMS)), F.lit(False))


def is_environmental(text: Column) -> Column:
    return is_bracketed_marker(text) & ~is_human_voice(text)


def is_blank_audio(text: Column) -> Column:
    bracket = text.contains("[") | text.contains("]")  # a cheap look first, as most words have none
    return F.coalesce(bracket & (F.upper(trim(text)).startswith("[BLANK") | (F.upper(trim(text)) == "AUDIO]")), F.lit(False))


def classify_sound(text: Column) -> Column:
    return (
        F.when(F.coalesce(trim(text), F.lit("")) == "", "blank").when(is_blank_audio(text), "blank").when(~is_bracketed_marker(text), "speech")
        .when(is_human_voice(text), "human_voice").otherwise("environmental")
    )


def categorize_phrase(texts: Column) -> Column:
    """blank, environmental or speech, from an array of word texts."""
    filled = F.filter(texts, lambda t: F.coalesce(trim(t), F.lit("")) != "")
    return (
        F.when(F.forall(filled, is_blank_audio), "blank").when(F.forall(filled, is_environmental), "environmental").otherwise("speech")
    )


def strip_blank_markers(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"(?i)\[BLANK[_\s]*AUDIO\]", ""))


def is_effectively_empty(texts: Column) -> Column:
    """The chunk has words and each is a blank marker."""
    return (F.size(texts) > 0) & F.forall(texts, lambda t: F.regexp_replace(F.upper(t), r"[\s_]", "") == "[BLANKAUDIO]")


def normalize_word(text: Column) -> Column:
    return trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9_\s]", ""))


def fuzzy_match(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    near = 1 - F.levenshtein(a, b) / longest >= 0.75
    return F.when((a == "") | (b == ""), False).otherwise(F.coalesce(a.contains(b) | b.contains(a) | near, F.lit(False)))


def sequence_similarity(a: Column, b: Column) -> Column:
    """Position by position: equal 1, alike 0.8, else 0; mean. 0 if lengths differ or are 0."""
    points = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).when(fuzzy_match(x, y), 0.8).otherwise(0.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(points, F.lit(0.0), lambda s, v: s + v) / F.size(a)).otherwise(0.0)


def tokenize(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9_\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def is_word_duplicate(a: Column, b: Column) -> Column:
    return (normalize_word(a) == normalize_word(b)) & (normalize_word(a) != "")


def format_time(seconds: Column) -> Column:
    """M:SS."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def format_duration(seconds: Column) -> Column:
    """H:MM:SS from an hour on, else M:SS."""
    whole = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    long = F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60))
    return F.when(whole >= 3600, long).otherwise(format_time(seconds))


def format_size(size: Column) -> Column:
    """B, KB or MB with one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", F.round(size / 1024, 1)), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.round(size / (1024 * 1024), 1)), F.lit(" MB")))
    )


def speaker_label(speaker_id: Column, name: Column) -> Column:
    """Unknown, Unknown N, the enrolled name or Speaker N."""
    return (
        F.when(speaker_id == -1, "Unknown").when(speaker_id <= -100, F.concat(F.lit("Unknown "), (-100 - speaker_id + 1).cast("string")))
        .when(name.isNotNull(), name).otherwise(F.concat(F.lit("Speaker "), (speaker_id + 1).cast("string")))
    )


def is_unknown_id(speaker_id: Column, display: bool = False) -> Column:
    """Numbered unknowns; for display the plain unknown too."""
    return (speaker_id <= -100) | (F.lit(display) & (speaker_id == -1))


def confusability(similarity: Column) -> Column:
    return F.when(similarity > 0.75, "HIGH").when(similarity > 0.65, "MODERATE").otherwise("NORMAL")
