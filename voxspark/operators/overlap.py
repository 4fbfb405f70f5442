"""Text that consecutive chunks of a channel share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.config import Overlap
from voxspark.functions import text as X
from voxspark.functions.vectors import let


def overlap_tail(words: Column, seconds: Column) -> Column:
    """Words that start within `seconds` of the last word's end; missing times count as 0."""
    limit = F.coalesce(F.element_at(words, -1)["end"], F.lit(0.0)) - seconds
    return F.when(F.size(words) > 0, F.filter(words, lambda w: F.coalesce(w["start"], F.lit(0.0)) >= limit)).otherwise(words)


def overlap_head(words: Column, seconds: Column) -> Column:
    return F.filter(words, lambda w: F.coalesce(w["start"], F.lit(0.0)) < seconds)


def previous_chunk(chunks: DataFrame, keys: list[str], order: list[str], words: str = "words", is_final: str | None = None) -> DataFrame:
    """Words of the chunk before in processing order; null after an empty or final one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    clears = F.size(words) <= 0
    if is_final:
        clears = clears | F.coalesce(F.col(is_final), F.lit(False))
    return chunks.withColumn("prev_words", F.lag(F.when(~clears, F.col(words))).over(w))


def packed(words: Column) -> Column:
    """Words (pos, text, start, end) in little space, for a shuffle: numbers in arrays of their own, texts in one string.

    Texts are joined by U+0000; that and U+0001 are escaped inside them, and a missing text has an escape too.
    """
    plain = lambda t: F.replace(F.replace(t, F.lit("\x01"), F.lit("\x01a")), F.lit("\x00"), F.lit("\x01b"))
    texts = F.array_join(F.transform(words, lambda w: F.coalesce(plain(w["text"]), F.lit("\x01n"))), "\x00")
    each = lambda c: F.transform(words, lambda w: w[c]).alias(c)
    return F.struct(each("pos"), each("start"), each("end"), texts.alias("texts"))


def unpacked(words: Column) -> Column:
    """The reverse of `packed`."""
    texts = F.split(words["texts"], "\x00", -1)
    back = lambda t: F.when(t != "\x01n", F.replace(F.replace(t, F.lit("\x01b"), F.lit("\x00")), F.lit("\x01a"), F.lit("\x01")))
    word = lambda all_texts: F.transform(words["pos"], lambda p, i: F.struct(p.alias("pos"), back(F.get(all_texts, i)).alias("text"), F.get(words["start"], i).alias("start"), F.get(words["end"], i).alias("end")))
    return let(texts, word)


def previous_packed(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """previous_chunk of words (pos, text, start, end), shuffled in the packed form."""
    tight = chunks.withColumns({"words": packed(F.col("words")), "__some": F.size("words") > 0})
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = tight.withColumn("prev_words", F.lag(F.when(F.col("__some"), F.col("words"))).over(w))
    return rows.withColumns({c: unpacked(F.col(c)) for c in ("words", "prev_words")}).drop("__some")


def align_overlap(chunks: DataFrame, config: Overlap = Overlap()) -> DataFrame:
    """Merge point of each chunk with the one before it: index, confidence, method, timestamp.

    chunks: words, prev_words, overlap. Windows are tried from the widest down, each along its diagonals (a place in
    the words before and one in the chunk's); the first width with a place that reaches the threshold ends the search.
    Of its places the most similar wins, then the first ones. The overlap bounds the number of words.
    """
    tail, head = overlap_tail(F.col("prev_words"), F.col("overlap")), overlap_head(F.col("words"), F.col("overlap"))
    rows = chunks.withColumns({"__tail": tail, "__head": head})
    rows = rows.withColumns({f"__{n}": F.transform(f"__{n}", lambda w: X.normalize_word(w["text"])) for n in ("tail", "head")} | {"__head_words": F.col("__head")})
    most = F.least(F.size("__tail"), F.size("__head"))
    sizes = F.when(most >= config.min_match, F.sequence(most, F.lit(config.min_match), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    places = lambda n, w: F.sequence(F.lit(0), F.size(n) - w)

    def candidate(w, i, j):
        similarity = X.sequence_similarity(F.slice("__tail", i + 1, w), F.slice("__head", j + 1, w))
        return F.struct(w.alias("w"), similarity.alias("similarity"), (-i).alias("i"), (-j).alias("j"))

    def at_width(w):
        every = F.flatten(F.transform(places("__tail", w), lambda i: F.transform(places("__head", w), lambda j: candidate(w, i, j))))
        return F.array_max(F.filter(every, lambda c: c["similarity"] >= config.threshold))

    # a width is looked at only while the wider ones gave nothing
    none_yet = F.lit(None).cast("struct<w:int,similarity:double,i:int,j:int>")
    best = F.aggregate(sizes, none_yet, lambda found, w: F.when(found.isNotNull(), found).otherwise(at_width(w)))
    rows = rows.withColumn("__best", best)
    matched = F.get("__head_words", F.col("__best.w") - F.col("__best.j") - 1)
    rows = rows.withColumn("__matched", matched)
    zero = F.lit(0.0)
    same = F.transform("words", lambda w: (w["text"] == F.col("__matched.text")) & (F.abs(F.coalesce(w["start"], zero) - F.coalesce(F.col("__matched.start"), zero)) < 0.1))
    none = F.col("prev_words").isNull() | (F.size("prev_words") == 0) | (F.size("words") == 0) | (F.col("overlap") <= 0)
    found = F.col("__best").isNotNull()
    return rows.select(
        *chunks.columns,
        F.when(none, 0).when(found, F.array_position(same, F.lit(True))).otherwise(0).cast("int").alias("merge_index"),
        F.when(none, 1.0).when(found, F.col("__best.similarity")).otherwise(0.0).alias("merge_confidence"),
        F.when(none, "no_overlap").when(found, "text_match").otherwise("no_text_match").alias("method"),
        F.when(none, F.lit(None)).when(found, F.coalesce(F.nullif(F.col("__matched.end"), zero), F.col("overlap"))).otherwise(F.col("overlap")).alias("merge_time"),
    )


def single_word_dedup(chunks: DataFrame) -> DataFrame:
    """Where the previous chunk's last word is this one's first, that word goes."""
    first, last = F.element_at("words", 1), F.element_at("prev_words", -1)
    same = F.col("prev_words").isNotNull() & (F.size("prev_words") > 0) & (F.size("words") > 0) & X.is_word_duplicate(last["text"], first["text"])
    rows = chunks.withColumn("__same", F.coalesce(F.when((F.size("words") > 0) & (F.coalesce(F.size("prev_words"), F.lit(0)) > 0), same), F.lit(False)))
    return rows.withColumns({"method": F.when(F.col("__same"), "single_word_dedup"), "cut_time": F.when(F.col("__same"), first["end"]), "words": F.when(F.col("__same"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))).otherwise(F.col("words"))}).drop("__same")


def trim_phrases_at_merge(phrases: DataFrame, chunk_keys: list[str], merge_time: str = "merge_time", overlap: str = "overlap") -> DataFrame:
    """Phrases from the merge time on; if none is left in a chunk, those that end after it, moved back by the overlap."""
    kept = F.col("start") >= F.col(merge_time)
    some = F.count_if(kept).over(Window.partitionBy(*chunk_keys)) > 0
    rows = phrases.withColumn("__some", some).where(F.when(F.col("__some"), kept).otherwise(F.col("end") > F.col(merge_time)))
    return rows.withColumns({
        "start": F.when(F.col("__some"), F.col("start")).otherwise(F.greatest(F.lit(0.0), F.col("start") - F.col(overlap))),
        "end": F.when(F.col("__some"), F.col("end")).otherwise(F.col("end") - F.col(overlap)),
    }).drop("__some")


def channel_time_offset(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sum of what earlier chunks of the channel add: duration less overlap, never negative."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("time_offset", F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("duration") - F.col("overlap"))).over(before), F.lit(0.0)))
