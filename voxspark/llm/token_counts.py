"""Token counts of whole texts by overlap resynchronisation.

Texts up to ``chunk`` + ``overlap`` characters are counted where they are read. Longer ones become
rows of overlapping chunks, encoded in parallel. In each overlap both neighbours name the token
boundaries that are proven stable: no entry of the vocabulary covers characters on both sides, so
no merge can cross and the tokens right of it do not depend on the text left of it. The first such
boundary that both neighbours have is where they are spliced. A document with an overlap that has
none is encoded again with chunks and overlaps four times as wide, at last as one chunk.

Defined results: null text equals the empty text, with 0 tokens; a document's repeated rows are
counted each; a null doc_id stays null; texts with the library's own space mark are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxspark.llm.common import documents, materialize, partitions
from voxspark.llm.pieces import IRREGULAR, SPACE, PieceCache, sentence_pieces

CHUNK = 24_000
OVERLAP = 400
LONGEST = 2**31 - 1


@cache
def vocabulary(path: str) -> tuple[frozenset[str], int, list[str], bool]:
    """Pieces with plain spaces, the longest one's length, pieces by id, whether no piece has a space after another character."""
    sp = sentence_pieces(path)
    texts = ["\0" if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ") for i in range(sp.get_piece_size())]
    return frozenset(texts), max(map(len, texts)), texts, not any(" " in t.lstrip(" ") for t in texts)


@cache
def counter(path: str) -> PieceCache:
    sp = sentence_pieces(path)
    return PieceCache(lambda pieces: sp.encode(pieces, num_threads=1), len)


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text that is encoded in one go."""
    if SPACE in text or IRREGULAR.search(text) or not vocabulary(path)[3]:
        return len(sentence_pieces(path).encode(text, num_threads=1))
    return sum(counter(path).values(text.split(" ")))


def stable(text: str, at: int, path: str) -> bool:
    """Whether no vocabulary entry covers characters on both sides of the place."""
    known, longest, _, inner_free = vocabulary(path)
    if inner_free and text[at] == " " != text[at - 1]:
        return True
    return not any(text[a:b] in known for a in range(max(0, at - longest + 1), at) for b in range(at + 1, min(len(text), a + longest) + 1))


def boundaries(chunk: str, path: str) -> tuple[int, dict[int, int]]:
    """Number of tokens of a chunk; for each character place that starts a token the tokens before it."""
    texts = vocabulary(path)[2]
    ids = sentence_pieces(path).encode(chunk, num_threads=1)
    sizes = [1 if texts[i] == "\0" else len(texts[i].encode()) for i in ids]
    place = {b: c for c, b in enumerate(accumulate((len(ch.encode()) for ch in chunk), initial=0))}
    # the library puts one space in front of every text it is given
    starts = {place[b - 1]: n for n, b in enumerate(accumulate(sizes, initial=0)) if b - 1 in place}
    return len(ids), starts


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


CHUNKS = "doc_id long, row long, n_bytes long, k int, of int, at long, chunk string"


def _chunks(size: int, overlap: int):
    """Chunk k starts at k * size and reaches `overlap` beyond the next one's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, n_bytes, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "n_bytes", "text")), strict=True):
                of = 1 if SPACE in text else max(1, -(-(len(text) - overlap) // size))
                for k in range(of):
                    chunk = text[k * size : (k + 1) * size + overlap] if k < of - 1 else text[k * size :]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "row": row, "n_bytes": n_bytes, "k": k, "of": of, "at": k * size, "chunk": chunk}], pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int32()), ("of", pa.int32()), ("at", pa.int64()), ("chunk", pa.string())]))

    return run


ENCODED = "doc_id long, row long, n_bytes long, k int, of int, n long, head map<long,long>, tail map<long,long>"


def _encode_chunks(path: str, size: int, overlap: int):
    """For each chunk its tokens, and in the zones shared with its neighbours the stable boundaries with the tokens before them."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.map_(pa.int64(), pa.int64())]
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def one(r: dict) -> list:
        text, k, of, at = r["chunk"], r["k"], r["of"], r["at"]
        if of == 1:
            return [r["doc_id"], r["row"], r["n_bytes"], k, of, count_tokens(text, path), [], []]
        n, starts = boundaries(text, path)

        def zone(low: int) -> list[tuple[int, int]]:
            # a proof needs the characters around the place, which both neighbours must hold
            reach = vocabulary(path)[1]
            return [(at + c, starts[c]) for c in range(low + reach, min(low + overlap, len(text)) - reach) if c in starts and stable(text, c, path)]

        return [r["doc_id"], r["row"], r["n_bytes"], k, of, n, zone(0) if k else [], zone(size) if k < of - 1 else []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def splice(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each document row; n_tokens is null where an overlap has no common boundary."""
    order = Window.partitionBy("row").orderBy("k")
    shared = lambda a, b: F.array_min(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    tokens = encoded.withColumns({"left": shared(F.lag("tail").over(order), F.col("head")), "right": shared(F.col("tail"), F.lead("head").over(order))})
    # an unmatched side gives null, and one null makes the document's sum null
    begin = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.element_at("head", F.col("left")))
    end = F.when(F.col("k") == F.col("of") - 1, F.col("n")).otherwise(F.element_at("tail", F.col("right")))
    part = tokens.select("row", "doc_id", "n_bytes", (end - begin).alias("part"))
    return part.groupBy("row", "doc_id", "n_bytes").agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens")).drop("row")


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, as the sentencepiece model counts it."""
    rows = documents(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.char_length("text") > chunk + overlap
    counted = rows.where(~is_long).mapInArrow(_encode_short(model), "doc_id long, n_bytes long, n_tokens long")
    pending, size, wide = rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), chunk, overlap
    while True:
        dealt = pending.mapInArrow(_chunks(size, wide), CHUNKS).repartition(partitions(docs.sparkSession), "row", "k")
        spliced = materialize(splice(dealt.mapInArrow(_encode_chunks(model, size, wide), ENCODED)), "token-counts")
        again = spliced.where("n_tokens IS NULL").select("doc_id").distinct()
        if size >= LONGEST or again.isEmpty():
            counted = counted.unionByName(spliced)
            break
        # all rows of a failed document go again, so none is counted twice
        counted = counted.unionByName(spliced.join(again.withColumnRenamed("doc_id", "failed"), F.col("doc_id").eqNullSafe(F.col("failed")), "left_anti"))
        pending = pending.join(again.withColumnRenamed("doc_id", "failed"), F.col("doc_id").eqNullSafe(F.col("failed")), "left_semi")
        size, wide = min(size * 4, LONGEST), wide * 4
        if wide > LONGEST // 4:
            size = LONGEST
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
