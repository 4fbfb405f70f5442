"""From words of chunks to transcript segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.config import Clustering
from voxspark.functions import text as X
from voxspark.functions.vectors import let
from voxspark.operators import clustering as C
from voxspark.operators import phrases as P
from voxspark.operators.phrases import join_text
from voxspark.operators.speakers import assign_enrolled_only, score_candidates


def join_split_markers(words: Column) -> Column:
    """A word that opens a bracket takes the following words up to the one that closes it; an unclosed one stays as it is.

    Between two words that close lies one span at most, from the first word there that opens; so the words' marks are
    one string, cut at the closing ones, and each word is looked at a few times however many there are.
    """
    holds = lambda w, bracket: F.coalesce(w["text"].contains(bracket), F.lit(False))
    closes = lambda w: holds(w, "]") & X.trim(w["text"]).endswith("]")
    opens = lambda w: holds(w, "[") & X.trim(w["text"]).startswith("[")
    mark = lambda w: F.when(closes(w), "c").when(opens(w), "o").otherwise(".")
    none = F.array().cast("array<int>")

    def firsts(marks: Column) -> Column:
        """Places at which what comes out begins."""
        closers = F.filter(F.transform(marks, lambda m, i: F.when(m == "c", i)), lambda i: i.isNotNull())
        parts = F.split(F.array_join(marks, ""), "c", -1)

        def places(part: Column, k: Column, ends: Column) -> Column:
            begin = F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(0)
            close, first = F.get(ends, k), F.instr(part, "o")  # 1 for the part's first word
            last = F.when(close.isNull(), F.size(marks) - 1).when(first > 0, begin + first - 1).otherwise(close)
            return F.when(last >= begin, F.sequence(begin, last)).otherwise(none)

        return let(closers, lambda ends: F.flatten(F.transform(parts, lambda part, k: places(part, k, ends))))

    def glued(ws: Column, a: Column, b: Column) -> Column:
        own = F.coalesce(F.get(ws, a)["text"], F.lit(""))
        text = F.when(a == b, own).otherwise(F.array_join(F.transform(F.sequence(a, b), lambda i: F.get(ws, i)["text"]), ""))
        return F.struct(text.alias("text"), F.get(ws, a)["start"].alias("start"), F.get(ws, b)["end"].alias("end"))

    def joined(ws: Column) -> Column:
        begins = let(F.transform(ws, mark), firsts)
        stop = lambda all_firsts, k: F.coalesce(F.get(all_firsts, k + 1), F.size(ws)) - 1
        return let(begins, lambda all_firsts: F.transform(all_firsts, lambda a, k: glued(ws, a, stop(all_firsts, k))))

    return let(words, joined)


def build_segments(phrases: DataFrame, offset: Column) -> DataFrame:
    """Absolute times of phrases and their words; a missing or zero word time falls back to the phrase's."""
    return phrases.withColumns({"start_time": offset + F.col("start"), "end_time": offset + F.col("end"), "text": join_text(F.col("words")), "words": timed_words(offset)})


def timed_words(offset: Column) -> Column:
    """A phrase's words with absolute times."""
    at = lambda w, c: offset + F.coalesce(F.nullif(w[c], F.lit(0.0)), F.col(c))
    return F.transform("words", lambda w: F.struct(w["text"].alias("text"), at(w, "start").alias("start"), at(w, "end").alias("end")))


def validate_transcription(rows: DataFrame, minimum: float = 0.7) -> DataFrame:
    """Share of the expected words, each occurrence counted, that the transcription holds."""
    rows = rows.withColumns({"__e": X.tokenize(F.col("expected")), "__t": X.tokenize(F.col("transcribed"))})
    # a join on words, so a long transcription is no array search
    heard = rows.select(*[c for c in rows.columns if c not in ("__e", "__t", "expected", "transcribed")], F.size("__e").alias("n"), F.array_distinct("__t").alias("__t"), "__e")
    found = F.size(F.array_intersect("__e", "__t"))
    counted = F.size(F.filter("__e", lambda w: F.array_contains(F.col("__t"), w)))
    ratio = F.when(F.col("n") == 0, 1.0).when(found == 0, 0.0).otherwise(counted / F.col("n"))
    out = heard.withColumn("ratio", ratio).withColumn("passed", F.col("ratio") >= minimum)
    return out.withColumn("warning", F.when(F.col("n") == 0, "no_expected_text").when(F.col("ratio") < 0.3, "very_low").when(F.col("ratio") < 0.7, "low")).drop("__t", "__e", "n")


def assign_in_order(phrases: DataFrame, roster: DataFrame, keys: list[str], order: list[str], config: Clustering) -> DataFrame:
    """Speakers of phrases, and candidates. A roster of num_speakers or more is closed, so no order counts; a smaller one is
    filled up with the speakers found, in a fold of each recording over its vectors alone."""
    named = [(r.name, list(r.centroid)) for r in roster.orderBy("idx").select("name", "centroid").take(config.num_speakers)]
    if len(named) >= config.num_speakers:
        return assign_enrolled_only(score_candidates(phrases, roster), config)
    own = list(dict.fromkeys([*keys, *order, "phrase_id"]))
    found = C.assign_speakers(phrases.select(*own, "embedding"), keys[:1], order, config, named, candidates=True).drop("embedding")
    names = F.array(*[F.lit(n) for n, _ in named]).cast("array<string>")
    found = found.withColumn("speaker_label", X.speaker_label(F.col("speaker_id"), F.get(names, F.col("speaker_id"))))
    other = found.select(*[F.col(c).alias(f"__{c}") if c in own else F.col(c) for c in found.columns])
    same = [phrases[c].eqNullSafe(other[f"__{c}"]) for c in own]
    return phrases.join(other, reduce(lambda x, y: x & y, same)).drop(*[f"__{c}" for c in own])


SPOKEN = ["speaker_id", "speaker_label", "similarity", "margin", "reason", "candidates"]
SPOKEN_TYPES = ["int", "string", "double", "double", "string", C.CANDIDATES]


def merge_transcript(phrases: DataFrame, roster: DataFrame, offset: Column, keys: list[str], config: Clustering = Clustering(), order: list[str] | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """Phrases of chunks to transcript rows: blank ones go, environmental ones have no speaker, others are assigned in `order`.

    keys: the recording, then what tells its chunks apart. A phrase without embedding takes all of the last assigned
    one of its chunk; without one it is `inherited` and goes, as do phrases without length and blank words in speech.
    A chunk of transcripts (keys, text, end, and the columns of offset) that has no phrases at all gives its text to speaker 0.
    """
    order = order or [*keys[1:], "start", "phrase_id"]
    texts = F.transform("words", lambda w: w["text"])
    rows = phrases.withColumn("kind", X.categorize_phrase(texts)).where("kind <> 'blank'")
    scored = assign_in_order(rows.where("kind = 'speech'"), roster, keys, order, config)
    last = Window.partitionBy(*keys).orderBy("start", "phrase_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in zip(SPOKEN, SPOKEN_TYPES, strict=True)])
    held = scored.withColumn("__own", F.last(F.when(F.col("embedding").isNotNull(), own), ignorenulls=True).over(last))
    speech = held.withColumns({c: F.col(f"__own.{c}") for c in SPOKEN} | {"reason": F.when(F.col("__own").isNull(), "inherited").otherwise(F.col("__own.reason"))})
    speech = P.drop_unusable(speech.drop("__own").withColumn("words", F.filter("words", lambda w: ~X.is_blank_audio(w["text"]))))
    nobody = {c: F.lit(None).cast(kind) for c, kind in zip(SPOKEN, SPOKEN_TYPES, strict=True)}
    filled = F.filter("words", lambda w: F.coalesce(X.trim(w["text"]), F.lit("")) != "")
    env = rows.where("kind = 'environmental'").withColumn("words", filled).where((F.size("words") > 0) & (F.col("end") != F.col("start"))).withColumns(nobody)
    out = build_segments(speech.unionByName(env), offset)
    if transcripts is None:
        return out
    have = phrases.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    bare = transcripts.join(have, reduce(lambda x, y: x & y, [transcripts[k].eqNullSafe(have[f"__{k}"]) for k in keys]), "left_anti")
    zero = roster.where("idx = 0").agg(F.first("name").alias("__name"))
    bare = bare.withColumn("text", X.strip_blank_markers(F.col("text"))).where("text <> ''").crossJoin(F.broadcast(zero))
    values = nobody | {"phrase_id": F.lit(0), "kind": F.lit("speech"), "speaker_id": F.lit(0), "speaker_label": F.coalesce("__name", F.lit("Speaker 1")), "candidates": F.array().cast(C.CANDIDATES)}
    values |= {"start": F.lit(0.0), "end": F.coalesce("end", F.lit(0.0)), "start_time": offset, "end_time": offset + F.coalesce("end", F.lit(0.0))}
    return out.unionByName(bare.withColumns(values).drop("__name"), allowMissingColumns=True).withColumn("words", F.coalesce("words", F.array()))
