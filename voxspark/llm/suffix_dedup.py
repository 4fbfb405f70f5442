"""Removal of byte strings that earlier documents hold, with range-partitioned suffixes.

Only suffixes that can repeat move. Every string of ``MATCH`` bytes has one anchor, the K bytes inside
it whose hash is smallest, leftmost on ties; equal strings have equal anchors at equal places. So:

1. Documents are written as chunks, rows of about ``CHUNK`` bytes of whole texts, bucketed by chunk.
2. Each chunk sends its distinct anchor hashes with their numbers of documents, in ranges of the
   hash; the answer is one byte an anchor: in one document only, in several, or in very many.
3. Suffixes whose anchor is in several documents are dealt into ranges of the anchor's leading bytes by
   splitters sampled from the anchors so dealt, in numbers that grow with the input; equal keys never
   straddle a splitter, so no run of equal strings crosses a boundary. Neighbouring suffixes of one anchor travel as one stretch of text, each distinct stretch
   of a chunk once, with its smallest doc_id. Suffixes of very frequent anchors travel singly, dealt
   by their whole first MATCH bytes, so a frequent line with ever other neighbours spreads out.
4. A range is cut once more by its anchors into buckets of about ``BUCKET`` bytes, so that ranges may
   outgrow it where the input has more than ``MAX_RANGES`` of them. In a bucket the suffixes are sorted
   by multikey quicksort, eight bytes being one character: runs of equal characters go on to the next,
   and those that hold one character only go on unsorted. Runs that last MATCH bytes are equal strings;
   those whose doc_id is not the smallest of the run are marked. The answer, a bit a suffix, returns to its chunk.
5. Each chunk covers the marked strings and reports its documents.

Defined results: null text equals the empty text; rows that repeat a doc_id don't remove each other's
bytes; a row with a null doc_id neither removes nor loses bytes; texts under MATCH bytes lose none; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import discard, documents, materialize, new_path, partitions
from voxspark.llm.shingles import mix

MATCH = 50
K = 20
CHUNK = 2_000_000
STEP = 1 << 15
FREQUENT = 4096
RANGE_BYTES = 4_000_000
MAX_RANGES = 1 << 20
BUCKET = 8_000_000
SAMPLED_CHUNKS = 64
SAMPLED_KEYS = 256
_U = np.uint64
_MASK = np.uint32(2 * STEP - 1)
_PLACES = np.arange(STEP + MATCH, dtype=np.uint32)
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
CHUNKS = 64
SAMPLED_KEYS = 256
_U = np.uint64
_TABLE = np.random.default_rng(4099).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xC2B2AE3D27D4EB4F
CHUNKS = "chunk long, ids array<long>, sizes array<long>, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on as a number, first byte lowest or (order >) highest."""
    return np.ndarray((max(0, len(data) - 7),), f"{order}u8", buffer=data, strides=(1,)).astype(_U)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes at each place, from the three numbers of eight bytes that cover them."""
    words = words_at(data)
    n = len(data) - K + 1
    h = words[:n] * _ODD[0]
    for at, odd in ((8, _ODD[1]), (K - 8, _ODD[2])):
        h ^= h >> _U(32)
        h += words[at : at + n]
        h *= odd
    h ^= h >> _U(29)
    h *= _ODD[0]
    h ^= h >> _U(32)
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        keys = np.minimum(keys[:-length], keys[length:])
        length *= 2
    return np.minimum(keys[: len(keys) - (width - length)], keys[width - length :]) if length < width else keys


def _begins(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... in numbers of counts[0], then those of begin[1], and so on."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Stretches:
    """Stretches of suffixes that share an anchor: anchor hash and place, first and last start, document's place.

    An anchor is the leftmost of the smallest hashes by their upper bits, as far as they fit beside a place in 32 bits.
    """

    def __init__(self, data: bytes, sizes: list[int], ids: list[int | None]):
        self.data, self.ids = data, np.array([i or 0 for i in ids], np.int64)
        bytes_, lengths, parts = np.frombuffer(data, np.uint8), np.asarray(sizes, np.int64), []
        whole = np.where([i is not None for i in ids], np.maximum(lengths - MATCH + 1, 0), 0)
        valid = np.repeat(np.tile([True, False], len(lengths)), np.stack([whole, lengths - whole], axis=1).ravel())
        for s in range(0, len(data) - MATCH + 1, STEP):
            g = gram_hashes(bytes_[s : s + STEP + MATCH - 1])
            keys = ((g >> _U(32)).astype(np.uint32) & ~_MASK) | _PLACES[: len(g)]
            at = window_minima(keys, MATCH - K + 1) & _MASK
            ok = valid[s : s + len(at)]
            # between two documents lie starts that aren't valid
            edge = np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]), [True]])
            first, last = np.flatnonzero(edge[:-1] & ok), np.flatnonzero(edge[1:] & ok)
            place = at[first].astype(np.int64)
            parts.append((g[place], place + s, first + s, last + s))
        empty = [np.empty(0, _U), *[np.empty(0, np.int64)] * 3]
        self.hash, self.anchor, self.first, self.last = map(np.concatenate, zip(*parts, strict=True)) if parts else empty
        self.doc = np.searchsorted(np.cumsum(lengths), self.first, side="right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes and the number of documents of each."""
        order = np.argsort(self.hash)
        hashes, docs = self.hash[order], self.doc[order]
        begin = _begins(hashes)
        times = np.diff(np.append(begin, len(hashes)))
        run = np.repeat(np.arange(len(begin)), times)
        several = (times > 1)[run]
        pairs = np.sort(run[several] * len(self.ids) + docs[several])
        counts = np.bincount(pairs[_begins(pairs)] // max(1, len(self.ids)), minlength=len(begin))
        return hashes[begin], np.maximum(counts, 1)

    def flags(self, answers: np.ndarray) -> np.ndarray:
        """The answer to each stretch's anchor, from those to the sorted distinct hashes."""
        order = np.argsort(self.hash)
        found = np.empty(len(order), np.uint8)
        begin = _begins(self.hash[order])
        found[order] = np.repeat(answers, np.diff(np.append(begin, len(order))))
        return found

    def heads(self, which: np.ndarray) -> np.ndarray:
        """The anchors' K bytes of some stretches."""
        if not len(which):
            return np.empty(0, f"S{K}")
        return np.ndarray((len(self.data) - K + 1,), f"S{K}", buffer=self.data, strides=(1,))[self.anchor[which]]


@cache
def _range_begins(n: int) -> np.ndarray:
    return np.array([-(-(i << 64) // n) for i in range(n)], dtype=_U)


def hash_ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the hash begins in sorted hashes, and the end."""
    return np.append(np.searchsorted(hashes, _range_begins(n)), len(hashes))


class Selected:
    """A chunk's suffixes whose anchors are in several documents, dealt into ranges.

    Slots are distinct stretches: texts, sizes (suffixes), owner (smallest document), range, place (of the anchor in
    the text), and their order by range, where begin and to tell each range's part. Occurrences have slot, first
    start, number of suffixes and document.
    """

    def __init__(self, s: Stretches, flags: np.ndarray, cuts: list[bytes], ranges: int):
        flag = s.flags(flags)
        one, many = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        each = s.last[many] - s.first[many] + 1
        self.first = np.concatenate([s.first[one], spread(s.first[many], each)])
        self.count = np.concatenate([s.last[one] - s.first[one], np.zeros(each.sum(), np.int64)]) + 1
        which = np.concatenate([one, np.repeat(many, each)])
        self.doc = s.doc[which]
        data, ends = s.data, self.first + self.count + (MATCH - 1)
        found = [data[a:b] for a, b in zip(self.first.tolist(), ends.tolist(), strict=True)]
        slots = dict.fromkeys(found)
        self.texts = [*slots]
        slots = dict(zip(self.texts, range(len(slots)), strict=True))
        self.slot = np.fromiter(map(slots.__getitem__, found), np.int64, len(found))
        # slots are numbered as they come, and documents come in order of their ids
        lead = np.flatnonzero(np.diff(np.maximum.accumulate(self.slot), prepend=-1))
        self.owner, self.sizes = s.ids[self.doc[lead]], self.count[lead]
        self.place = (s.anchor[which] - self.first)[lead]
        self.range = np.empty(len(lead), np.int64)
        dealt = int(np.searchsorted(lead, len(one)))
        self.range[:dealt] = np.searchsorted(np.array(cuts, dtype=f"S{K}"), s.heads(which[lead[:dealt]]), side="right")
        self.range[dealt:] = [int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "big") % ranges for t in self.texts[dealt:]]
        self.order = np.argsort(self.range, kind="stable")
        self.begin = _begins(self.range[self.order])
        self.to = self.range[self.order][self.begin]


def equal_runs(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that agree in MATCH bytes with another one, in order of their bytes, and where each run of equals begins.

    words[i]: the eight bytes at place i as a number. Multikey quicksort, all runs of a depth at once: the
    runs of equal characters go on to the next character, where only runs with several are sorted.
    """
    active, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    new = np.arange(len(starts)) == 0
    for depth in range(0, MATCH, 8):
        if not len(active):
            break
        char = words[starts[active] + depth] >> _U(8 * max(0, depth + 8 - MATCH))
        begin = np.flatnonzero(new)
        unequal = np.maximum.reduceat(char, begin) != np.minimum.reduceat(char, begin)
        several = np.flatnonzero(unequal[run])
        if len(several):
            order = several[np.argsort(char[several]) if len(begin) == 1 else np.lexsort((char[several], run[several]))]
            active[several], char[several] = active[order], char[order]
        new = np.concatenate([[True], (char[1:] != char[:-1]) | (run[1:] != run[:-1])])
        run = np.cumsum(new) - 1
        repeated = (np.bincount(run) > 1)[run]
        active, new = active[repeated], new[repeated]
        run = np.cumsum(new) - 1
    return active, np.flatnonzero(new)


def pieces_of(data: bytes, begin: np.ndarray) -> pa.Array:
    """A binary column of the bytes from each begin to the next, the last one being the end."""
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)])


def _chunk_rows(target: int):
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            rows = sorted(held, key=lambda x: (x[0] is None, x[0] or 0))
            return pa.RecordBatch.from_pylist([{"chunk": number, "ids": [d for d, _ in rows], "sizes": [len(t) for _, t in rows], "data": b"".join(t for _, t in rows)}], schema)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.append((doc, text.encode("utf-8", "surrogatepass")))
                size += len(held[-1][1])
                if size >= target:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return run


def _send_anchors(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                hashes, counts = Stretches(r["data"], r["sizes"], r["ids"]).anchors()
                at = hash_ranges(hashes, ranges)
                some = np.flatnonzero(np.diff(at))
                begin, counts = np.append(at[some], at[-1]), np.minimum(counts, 65535).astype(np.uint16)
                columns = [pa.array(np.full(len(some), r["chunk"], np.int64)), pa.array(some.astype(np.int32)), pieces_of(hashes.tobytes(), 8 * begin), pieces_of(counts.tobytes(), 2 * begin)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "range", "hashes", "counts"])

    return run


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each range, from batches sorted by range."""
    at, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            r = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            if r["range"] != at and held:
                yield at, held
                held = []
            at = r["range"]
            held.append(r)
    if held:
        yield at, held


ANSWER = "chunk long, range int, answer binary"


def _answers(at: int, chunks: list[int], answers: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([at] * len(chunks), pa.int32()), pa.array(answers, pa.binary())], ["chunk", "range", "answer"])


def _judge_anchors(frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _by_range(batches):
            hashes = np.concatenate([np.frombuffer(r["hashes"], _U) for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in rows])
            _, inverse = np.unique(hashes, return_inverse=True)
            total = np.bincount(inverse, weights=counts)[inverse]
            flags = (total > 1).astype(np.uint8) + (total > frequent).astype(np.uint8)
            cuts = np.cumsum([len(r["counts"]) // 2 for r in rows])[:-1]
            yield _answers(at, [r["chunk"] for r in rows], [f.tobytes() for f in np.split(flags, cuts)])

    return run


def _joined(answers: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(a["answer"] for a in sorted(answers, key=lambda a: a["range"])), np.uint8)


def _send_suffixes(cuts: list[bytes], ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Selected(Stretches(r["data"], r["sizes"], r["ids"]), _joined(r["flags"] or []), cuts, ranges)
                sizes, begin = s.sizes[s.order], np.append(s.begin, len(s.order))
                ends = np.append(0, np.cumsum(sizes + MATCH - 1))[begin]
                columns = [
                    pa.array(np.full(len(s.to), r["chunk"], np.int64)), pa.array(s.to.astype(np.int32)), pieces_of(s.owner[s.order].tobytes(), 8 * begin),
                    pieces_of(sizes.astype(np.uint8).tobytes(), begin), pieces_of(s.place[s.order].astype(np.uint8).tobytes(), begin),
                    pieces_of(b"".join([s.texts[i] for i in s.order.tolist()]), ends),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "range", "docs", "counts", "places", "texts"])

    return run


def mark_repeats(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """A mark a suffix, stretch by stretch: whether a smaller document holds the same MATCH bytes.

    Equal stretches are compared once, as that of their smallest document; all later ones are marked whole.
    """
    first = dict.fromkeys(texts)
    distinct = [*first]
    first = dict(zip(distinct, range(len(distinct)), strict=True))
    same = np.fromiter(map(first.__getitem__, texts), np.int64, len(texts))
    owner = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(owner, same, docs)
    counts = np.fromiter(map(len, distinct), np.int64, len(distinct)) - (MATCH - 1)
    text = np.frombuffer(b"".join(distinct) + bytes(16), np.uint8)
    starts = spread(np.cumsum(counts + MATCH - 1) - (counts + MATCH - 1), counts)
    held, marked = np.repeat(owner, counts), np.zeros(len(starts), bool)
    members, runs = equal_runs(words_at(text, ">"), starts)
    if len(members):
        least = np.minimum.reduceat(held[members], runs)
        marked[members] = held[members] > np.repeat(least, np.diff(np.append(runs, len(members))))
    at, times = np.cumsum(counts) - counts, counts[same]
    return marked[spread(at[same], times)] | np.repeat(docs > owner[same], times)


def buckets(texts: list[bytes], places: np.ndarray, size: int) -> list[np.ndarray]:
    """The stretches in buckets of about size bytes by their anchors; equal anchors share a bucket."""
    total = sum(map(len, texts))
    if total <= size:
        return [np.arange(len(texts))]
    heads = np.array([t[p : p + K] for t, p in zip(texts, places.tolist(), strict=True)], dtype=f"S{K}")
    order = np.argsort(heads, kind="stable")
    lengths = np.cumsum(np.array([len(t) for t in texts], np.int64)[order])
    first = np.flatnonzero(np.concatenate([[True], heads[order][1:] != heads[order][:-1]]))
    bucket = (lengths[first] - 1) // size
    return np.split(order, first[np.flatnonzero(np.diff(bucket)) + 1])


def _judge_suffixes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _by_range(batches):
            joined, held = b"".join([r["texts"] for r in rows]), [len(r["counts"]) for r in rows]
            counts, places = (np.frombuffer(b"".join([r[k] for r in rows]), np.uint8).astype(np.int64) for k in ("counts", "places"))
            owners = np.frombuffer(b"".join([r["docs"] for r in rows]), np.int64)
            ends = np.cumsum(counts + MATCH - 1).tolist()
            texts = [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            ends = np.cumsum(counts)
            marks = np.empty(counts.sum(), bool)
            for some in buckets(texts, places, size):
                marks[spread((ends - counts)[some], counts[some])] = mark_repeats([texts[i] for i in some.tolist()], owners[some])
            cuts = ends[np.cumsum(held) - 1].tolist()
            yield _answers(at, [r["chunk"] for r in rows], [np.packbits(marks[x:y]).tobytes() for x, y in zip([0, *cuts], cuts, strict=False)])

    return run


def removed_bytes(s: Stretches, chosen: Selected, answers: dict[int, bytes]) -> np.ndarray:
    """Which bytes of the chunk are covered by marked strings."""
    gone = np.zeros(len(s.data), bool)
    if not len(chosen.texts):
        return gone
    sizes = chosen.sizes[chosen.order]
    parts = np.add.reduceat(sizes, chosen.begin).tolist()
    marks = np.concatenate([np.unpackbits(np.frombuffer(answers[to], np.uint8), count=n) for to, n in zip(chosen.to.tolist(), parts, strict=True)]).astype(bool)
    at = np.empty(len(sizes), np.int64)
    at[chosen.order] = np.cumsum(sizes) - sizes
    # a later document of the same chunk holds what the slot's owner holds
    later = s.ids[chosen.doc] > chosen.owner[chosen.slot]
    for some in range(0, len(later), 1 << 16):
        slot, first, count, sure = (x[some : some + (1 << 16)] for x in (chosen.slot, chosen.first, chosen.count, later))
        gone[spread(first, count)] = marks[spread(at[slot], count)] | np.repeat(sure, count)
    width = 1
    while width < MATCH:
        step = min(width, MATCH - width)
        gone[step:] |= gone[:-step].copy()
        width += step
    return gone


def _report(cuts: list[bytes], ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Stretches(r["data"], r["sizes"], r["ids"])
                chosen = Selected(s, _joined(r["flags"] or []), cuts, ranges)
                gone = removed_bytes(s, chosen, {a["range"]: a["answer"] for a in r["marks"] or []})
                kept, sizes = np.frombuffer(s.data, np.uint8)[~gone].tobytes(), np.asarray(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                opens, begin = gone.copy(), (ends - sizes)[sizes > 0]
                opens[1:] &= ~gone[:-1]
                opens[begin] = gone[begin]
                removed, spans = ([np.count_nonzero(x[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)] for x in (gone, opens))
                at = np.cumsum(sizes - removed).tolist()
                digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip([0, *at], at, strict=False)]
                columns = [pa.array(c, pa.int64()) for c in (r["ids"], sizes, removed, spans)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading bytes of some anchors that are dealt by them, with a number that sets equal ones apart."""
    for b in batches:
        for r in b.to_pylist():
            s = Stretches(r["data"], r["sizes"], r["ids"])
            dealt = np.flatnonzero(s.flags(_joined(r["flags"] or [])) == 1)
            order = mix(s.hash[dealt])
            few = dealt[np.argsort(order)[:SAMPLED_KEYS]]
            apart = mix(s.anchor[few].astype(_U) + _U(r["chunk"] * int(_ODD[0]) % 2**64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([s.data[p : p + K] for p in s.anchor[few].tolist()], pa.binary()), pa.array(apart)], ["key", "apart"])


def _every(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            yield b.take(pa.array(range(-seen % step, b.num_rows, step), pa.int64()))
            seen += b.num_rows

    return run


def sorted_keys(keys: DataFrame, n: int) -> DataFrame:
    """Keys in n ranges; equal ones, set apart by their numbers, may spread over several."""
    return keys.repartitionByRange(n, "key", "apart").sortWithinPartitions("key", "apart").select("key")


def splitters(flagged: DataFrame, chunks: int, ranges: int, n: int) -> list[bytes]:
    """At most ranges - 1 keys between the ranges.

    One chunk of SAMPLED_CHUNKS, and that many at least, gives SAMPLED_KEYS keys; they are sorted on the
    cluster and thinned to about four a range, so that the driver sees at most 4 * MAX_RANGES of K bytes.
    """
    taken = max(SAMPLED_CHUNKS, chunks // SAMPLED_CHUNKS)
    few = flagged.where(F.pmod(F.xxhash64("chunk"), F.lit(1 << 30)) < (1 << 30) * min(1.0, taken / max(1, chunks)))
    keys = materialize(few.mapInArrow(_sample_keys, "key binary, apart long"), "splitters")
    step = max(1, keys.count() // (4 * ranges))
    thinned = sorted_keys(keys, n).mapInArrow(_every(step), "key binary")
    sample = sorted(bytes(r["key"]) for r in thinned.collect())
    discard(keys)
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, frequent: int = FREQUENT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    path = new_path(spark, "chunks")
    table = "voxspark_" + path[-32:]
    rows = documents(docs, id_col, text_col).mapInArrow(_chunk_rows(chunk), CHUNKS)
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "chunk").saveAsTable(table)
    chunks = spark.table(table)
    size, count = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(n, min(MAX_RANGES, -(-size // RANGE_BYTES)))
    dealt = lambda df: df.repartitionById(n, F.pmod("range", F.lit(n)).cast("int")).sortWithinPartitions("range", "chunk")
    told = lambda df, name: df.groupBy("chunk").agg(F.collect_list(F.struct("range", "answer")).alias(name))
    flags = materialize(dealt(chunks.mapInArrow(_send_anchors(ranges), "chunk long, range int, hashes binary, counts binary")).mapInArrow(_judge_anchors(frequent), ANSWER), "anchors")
    flagged = chunks.join(told(flags, "flags"), "chunk", "left")
    cuts = splitters(flagged, count, ranges, n)
    sent = flagged.mapInArrow(_send_suffixes(cuts, ranges), "chunk long, range int, docs binary, counts binary, places binary, texts binary")
    marks = materialize(dealt(sent).mapInArrow(_judge_suffixes(bucket), ANSWER), "suffixes")
    return flagged.join(told(marks, "marks"), "chunk", "left").mapInArrow(_report(cuts, ranges), RESULT)
