"""Packing of token pieces into sequences by minimum bin slack.

Each document is encoded where it is read, by the byte-level vocabulary and merges of a tokenizers
json, and cut after every ``capacity`` ids; whole pieces are
sequences of their own. A remainder of over half the capacity is cut once more, after that half, so
that no piece needs a window almost alone. All are dealt into groups by their place in the written
table, so no key, null or repeated, makes a large group. In a group the
longest remaining piece opens a sequence; a dynamic program over a bitset of reachable sums picks,
from the multiset of remaining lengths, the one that fills the window closest to capacity, and
backtracking gives how many pieces of each length it takes.

Defined results: null text equals the empty text, whose only id is the closing id; repeated rows are
packed each; an empty table gives no pieces. sequence_id is unique over all groups; offsets in a
sequence follow each other without gaps. Only (doc, start, length, checksum) rows move, never ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import documents, materialize, slices
from voxspark.llm.pieces import byte_bpe

CAPACITY = 1024
CLOSING = bytes(4)  # id 0
PER_GROUP = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encode_bytes(text: str, tokenizer: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a text and the closing id."""
    ids = byte_bpe(tokenizer).encode_to_numpy(text, allowed_special="all")
    return ids.astype("<u4", copy=False).tobytes() + CLOSING


def cuts(n: int, capacity: int) -> list[int]:
    """Where a document of n ids is cut: every capacity ids, and a remainder of over half of that once more."""
    found = [*range(0, n, capacity), n]
    if n % capacity > capacity // 2:
        found.insert(-1, found[-2] + capacity // 2)
    return found


def _cut(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = memoryview(encode_bytes(text, tokenizer))
                n = len(ids) // 4
                at = cuts(n, capacity)
                out += [(doc, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n) for s, e in zip(at, at[1:], strict=False)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length come closest to the room without exceeding it."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left and not reach & goal:
            take = min(many, left)
            steps.append((reach, length, take))
            reach |= (reach << length * take) & mask
            left, many = left - take, many * 2
        if reach & goal:
            break
    at, picked = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= length * take
    return picked


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of places in `lengths`, each of at most `capacity` in sum."""
    by_length: dict[int, list[int]] = {}
    for place in sorted(range(len(lengths)), reverse=True):
        by_length.setdefault(lengths[place], []).append(place)
    counts, sequences = {k: len(v) for k, v in by_length.items()}, []

    def take(length: int) -> int:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return by_length[length].pop()

    while counts:
        first = max(counts)
        places = [take(first)]
        for length, n in fill(capacity - first, counts).items():
            places += [take(length) for _ in range(n)]
        sequences.append(places)
    return sequences


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece. tokenizer: a byte-level json."""
    pieces = materialize(documents(docs, id_col, text_col).mapInArrow(_cut(tokenizer, capacity), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // PER_GROUP))
    # by place in the written table, so that pieces of one doc_id, or of none, spread like all others
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("group", F.pmod(F.shiftright(place, 33) * 977 + place.bitwiseAND((1 << 33) - 1), F.lit(groups)))

    def group(part: pa.Table) -> pa.Table:
        lengths, (g,) = part.column("length").to_pylist(), set(part.column("group").to_pylist())
        sequences = pack_lengths(lengths, capacity)
        number = [(g << 32) + n for n, s in enumerate(sequences) for _ in s]
        offset = [x for s in sequences for x in accumulate([lengths[p] for p in s[:-1]], initial=0)]
        out = part.drop_columns(["group"]).take([p for s in sequences for p in s])  # ids never leave Arrow
        return out.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("group").applyInArrow(group, f"{PIECES}, sequence_id long, offset long")
