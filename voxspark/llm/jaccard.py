"""N-gram Jaccard join with signature trees, exact and as connected components.

A set of shingles can link only if enough of its shingles are in other documents too. So:

1. Texts are read once, in chunks. A chunk sends its distinct shingles, as 48-bit slots in order, to
   ranges of the slots, each once however many of its documents hold it; a range answers how many
   slots each document shares with others. Documents below ``percent`` of their size link with none.
2. For the rest the exact shingles are counted. Ordered by count, then value, two sets that link
   have one of their first ``n - ceil(n * percent / 100) + 1`` shingles in common: their signatures.
3. Sets are sorted by their least and by their greatest shingle, so that near copies lie together,
   and every ``NODE`` neighbours are compared; what links is one component from then on.
4. The tree: its lowest level are nodes of up to ``NODE`` sets, in order of their component if it is
   large and of their most frequent signature, with size range and components. Their OR-combined signatures are kept sparse, one row a
   set bit, so the walk of all node pairs is an equality join on the bits: pairs without a common bit
   have too small a greatest overlap and never meet. Pairs that can't link by size range or are one
   component are pruned too. Of a pair only the sets that have common bits go on.
5. A pair of nodes is one small task: below each node a tree of dense OR-combined bitmaps with size
   ranges, both walked at once, pairs pruned by their greatest possible overlap; leaf pairs not yet
   connected are compared exactly.
6. Connected components of all links.

Equality of shingles and of whole sets is judged on 64-bit and 128-bit hashes; slots only filter.

Defined results: null text equals the empty text; documents without words link with nothing; rows
that repeat a doc_id are one node, each row with its own set size; a null doc_id has a null
component; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import discard, documents, from_planes, materialize, partitions, planes, slices
from voxspark.llm.graph import components
from voxspark.llm.shingles import shingle_set

CHUNK = 1 << 19
CHUNK_DOCS = 60_000
RANGE = 2_000_000
SLOT_BITS = 48
NODE = 64
OWN_NODES = 32
NEIGHBOURS = 8
BITS = 2048
LEAF = 8
BROADCAST_IDS = 1_000_000
_U = np.uint64


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# ---- 1. which documents share enough slots

SENT = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("slots", pa.binary()), ("owners", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("shared", pa.binary())])
SENT_DDL = "chunk long, range long, slots binary, owners binary, ids array<long>, sizes array<long>, digests array<binary>, shared binary"
SEVERAL = 65535


def slot_rows(chunk: int, docs: list[tuple[int | None, np.ndarray]], ranges: int) -> list[dict]:
    """What a chunk sends: its slots by range with their owner in the chunk, and a row of its documents.

    A slot of several documents of the chunk is known to be shared: it is counted here and sent without owner.
    """
    linkable = [s if d is not None else s[:0] for d, s in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in linkable])
    slot = (np.concatenate(linkable) if linkable else np.empty(0, _U)) >> _U(64 - SLOT_BITS)
    order = np.argsort(slot)
    slot, owner = slot[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.empty(0, np.int64)
    many = np.diff(np.append(first, len(slot))) > 1
    shared = np.bincount(owner[np.repeat(many, np.diff(np.append(first, len(slot))))], minlength=len(docs)).astype(np.int32)
    slot, owner = slot[first], np.where(many, SEVERAL, owner[first]).astype(np.uint16)
    at = np.searchsorted(slot, np.array([-(-(i << SLOT_BITS) // ranges) for i in range(ranges + 1)], dtype=_U)).tolist()
    none = {"slots": None, "owners": None, "ids": None, "sizes": None, "digests": None, "shared": None}
    rows = [none | {"chunk": chunk, "range": i, "slots": planes(np.diff(slot[x:y], prepend=_U(0))), "owners": planes(owner[x:y])} for i, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
    return [*rows, none | {"chunk": chunk, "range": -1 - ((chunk >> 32) + chunk) % 4096, "ids": [d for d, _ in docs], "sizes": [len(s) for _, s in docs], "digests": [digest(s) for _, s in docs], "shared": shared.tobytes()}]


def _send_slots(words: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.append((doc, shingle_set(text, words)))
                size += len(held[-1][1])
                if size >= CHUNK or len(held) >= CHUNK_DOCS:
                    yield pa.RecordBatch.from_pylist(slot_rows(chunk, held, ranges), SENT)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist(slot_rows(chunk, held, ranges), SENT)

    return run


def shared_slots(slots: list[np.ndarray], owners: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk of a range the owners of slots that another chunk, or several documents, hold."""
    every, owner = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(every)
    s = every[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    again &= owner != SEVERAL
    cuts = np.cumsum([len(x) for x in slots])[:-1]
    return [o[g] for o, g in zip(np.split(owner, cuts), np.split(again, cuts), strict=True)]


def _judge_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by range, for each chunk how many slots of each owner are shared; document rows pass."""
    at, held = None, []

    def answer() -> pa.RecordBatch:
        found = shared_slots([np.cumsum(from_planes(r["slots"], _U), dtype=_U) for r in held], [from_planes(r["owners"], np.uint16) for r in held])
        rows = []
        for r, o in zip(held, found, strict=True):
            owners, counts = np.unique(o, return_counts=True)
            rows.append(dict.fromkeys(SENT.names) | {"chunk": r["chunk"], "range": r["range"], "owners": owners.astype(np.uint16).tobytes(), "shared": counts.astype(np.int32).tobytes()})
        return pa.RecordBatch.from_pylist(rows, SENT)

    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if r["range"] != at and held:
                yield answer()
                held = []
            at = r["range"]
            if at < 0:
                yield pa.RecordBatch.from_pylist([r], SENT)
            else:
                held.append(r)
    if held:
        yield answer()


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("linkable", pa.bool_())])


def _sum_slots(percent: int):
    """From rows sorted by chunk and range, so that a chunk's document row comes first."""

    def out(r: dict, shared: np.ndarray) -> pa.RecordBatch:
        n = np.array(r["sizes"], dtype=np.int64)
        linkable = (shared >= -(-n * percent // 100)) & (n > 0) & np.array([i is not None for i in r["ids"]], dtype=bool)
        return pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(n), pa.array(r["digests"], pa.binary()), pa.array(linkable)], schema=SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, shared = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    if row:
                        yield out(row, shared)
                    row, shared = r, np.frombuffer(r["shared"], np.int32).astype(np.int64)
                else:
                    shared[np.frombuffer(r["owners"], np.uint16)] += np.frombuffer(r["shared"], np.int32)
        if row:
            yield out(row, shared)

    return run


def sketches(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, linkable): linkable documents share enough slots with others."""
    n = partitions(texts.sparkSession)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ranges = max(n, -(-size // (5 * RANGE)))
    sent = texts.mapInArrow(_send_slots(words, ranges), SENT_DDL)
    judged = sent.repartitionById(n, F.pmod("range", F.lit(n)).cast("int")).sortWithinPartitions("range").mapInArrow(_judge_slots, SENT_DDL)
    summed = judged.repartition(n, "chunk").sortWithinPartitions("chunk", "range").mapInArrow(_sum_slots(percent), "doc_id long, n_shingles long, digest binary, linkable boolean")
    return materialize(summed, "sketch")


# ---- dense trees below two nodes


class Tree:
    """Signature tree over sets sorted by size: levels[0] are the leaves."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = len(sets)
        bits = np.zeros((n, BITS // 8), np.uint8)
        for i, s in enumerate(sets):
            np.bitwise_or.at(bits[i], ((s >> _U(3)) % _U(BITS // 8)).astype(np.int64), np.left_shift(1, (s & _U(7)).astype(np.uint8)).astype(np.uint8))
        maps, sizes = bits.view(_U), np.array([len(s) for s in sets])
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(maps), LEAF)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def close(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a link: by size range and greatest possible overlap."""
    fits = (a[2][i] * 100 >= percent * b[1][j]) & (b[2][j] * 100 >= percent * a[1][i])
    overlap = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])
    overlap = np.minimum(overlap, np.minimum(a[2][i], b[2][j]))
    return fits & (overlap * (100 + percent) >= percent * (a[1][i] + b[1][j]))


def pairs_of(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Leaf pairs that survive the walk of two trees (or of one with itself, then i < j)."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    todo = [(la, lb, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        la, lb, i, j = todo.pop()
        ok = close(a.levels[la], i, b.levels[lb], j, percent)
        if a is b:
            ok &= i <= j
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == lb == 0:
            yield from ((x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if a is not b or x < y)
            continue
        # children of the higher node of each pair, or of both
        da, db = la >= lb and la > 0, lb >= la and lb > 0
        ca = (i[:, None] * LEAF + np.arange(LEAF)) if da else i[:, None]
        cb = (j[:, None] * LEAF + np.arange(LEAF)) if db else j[:, None]
        x, y = np.repeat(ca, cb.shape[1], axis=1).ravel(), np.tile(cb, (1, ca.shape[1])).ravel()
        inside = (x < len(a.levels[la - da][0])) & (y < len(b.levels[lb - db][0]))
        x, y = x[inside], y[inside]
        todo += [(la - da, lb - db, x[k : k + 4096], y[k : k + 4096]) for k in range(0, len(x), 4096)]


#: node, component so far, set
Member = tuple[int, int, np.ndarray]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(first: list[Member], second: list[Member] | None, percent: int) -> list[tuple[int, int]]:
    """Links of the sets of one node, or of two, that connect components; no more than connect them."""
    if not first or second == []:
        return []
    first = sorted(first, key=lambda x: len(x[2]))
    second = first if second is None else sorted(second, key=lambda x: len(x[2]))
    root = {c: c for _, c, _ in [*first, *second]}

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    a = Tree([s for *_, s in first])
    b, found = a if second is first else Tree([s for *_, s in second]), []
    for i, j in pairs_of(a, b, percent):
        x, y = find(first[i][1]), find(second[j][1])
        if x != y and linked(a.sets[i], b.sets[j], percent):
            root[max(x, y)] = min(x, y)
            found.append((first[i][0], second[j][0]))
    return found


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=LINKS)


def _compare_neighbours(percent: int):
    """Sets in order: every NODE of them are compared with each other and with the last few before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Member] = []
        for b in batches:
            found = []
            for node, hashes in zip(b.column("node").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                held.append((node, node, np.frombuffer(hashes, _U)))
                if len(held) == NODE + NEIGHBOURS:
                    found += links(held, None, percent)
                    held = held[-NEIGHBOURS:]
            yield _links(found)
        yield _links(links(held, None, percent))

    return run


def _compare_nodes(percent: int):
    """Streams rows sorted by (i, j); the sets of one pair of nodes, 2 * NODE at most, are held together."""

    def solve(rows: list[tuple], i: int, j: int) -> list[tuple[int, int]]:
        side = lambda k: [(n, c, np.frombuffer(s, _U)) for leaf, n, c, s in rows if leaf == k]
        return links(side(i), None if i == j else side(j), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for i, j, leaf, node, component, hashes in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "leaf", "node", "component", "hashes")), strict=True):
                if (i, j) != key:
                    found += solve(held, *key) if held else []
                    key, held = (i, j), []
                held.append((leaf, node, component, hashes))
            yield _links(found)
        if held:
            yield _links(solve(held, *key))

    return run


# ---- the whole join


def _set_rows(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("hashes", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), *(pa.array([int(s[at] >> _U(1)) if len(s) else 0 for s in sets], pa.int64()) for at in (0, -1))], schema=schema)

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        sets = [np.frombuffer(h, np.int64) for h in b.column("hashes").to_pylist()]
        node = np.repeat(b.column("node").to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(node)], ["shingle", "node"])


def signatures(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, bits, held): the shingles of which two sets that link have one in common, rarest first, and how many
    sets hold the last of them; sets that can't link are left out."""
    rows = sets.mapInArrow(_shingle_rows, "shingle long, node long")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = rows.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    spare = F.size("s") - F.ceil(F.col("n") * percent / 100) + 1
    found = shared.join(sets.select("node", "n"), "node").where(spare > 0)
    return found.select("node", "n", F.slice("s.shingle", F.lit(1), spare.cast("int")).alias("bits"), F.element_at("s.held", spare.cast("int")).alias("held"))


def links_of_sets(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of links (a, b) of the sets (node, n, hashes), as many as connect what is connected."""
    n = partitions(sets.sparkSession)
    signed = materialize(signatures(sets, percent), "signatures")
    able = sets.select("node", "low", "high", "hashes").join(signed.select("node"), "node", "left_semi")
    orders = [able.repartitionByRange(n, c, "node").sortWithinPartitions(c, "node").select("node", "hashes") for c in ("low", "high")]
    near = materialize(orders[0].mapInArrow(_compare_neighbours(percent), "a long, b long").unionByName(orders[1].mapInArrow(_compare_neighbours(percent), "a long, b long")).distinct(), "near")
    found = components(near)
    labelled = materialize(signed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    own = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= OWN_NODES)
    placed = labelled.join(own, "component", "left").withColumn("own", F.when(F.col("members").isNotNull(), F.col("component")).otherwise(F.lit(-1)))
    # position in the order, cut into nodes and places in them; written, so that both stay
    order = ("own", "held", F.element_at("bits", -1), "node")
    placed = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    position = F.monotonically_increasing_id()
    place = [F.shiftright(position, NODE.bit_length() - 1).alias("leaf"), position.bitwiseAND(NODE - 1).cast("int").alias("place")]
    leaves = materialize(placed.select("node", "n", "component", "bits", *place), "leaves")
    bits = leaves.select(F.explode("bits").alias("bit"), "leaf", "component", "n", F.expr("shiftleft(1L, place)").alias("member"))
    ranges = [f(c).alias(f"{p}_{c}") for c in ("component", "n") for p, f in (("min", F.min), ("max", F.max))]
    nodes = bits.groupBy("bit", "leaf").agg(*ranges, F.bit_or("member").alias("members"))
    apart = bits.groupBy("bit").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("bit")
    nodes = materialize(nodes.join(apart, "bit"), "nodes")
    a, b = nodes.alias("a"), nodes.alias("b")
    several = "(a.min_component <> a.max_component OR b.min_component <> b.max_component OR a.min_component <> b.min_component)"
    fits = f"a.max_n * 100 >= {percent} * b.min_n AND b.max_n * 100 >= {percent} * a.min_n"
    met = a.join(b, F.expr(f"a.bit = b.bit AND a.leaf <= b.leaf AND {several} AND {fits}"))
    pairs = met.groupBy(F.col("a.leaf").alias("i"), F.col("b.leaf").alias("j")).agg(F.bit_or("a.members").alias("x"), F.bit_or("b.members").alias("y"))
    members = lambda leaf, mask: F.expr(f"transform(filter(sequence(0, {NODE - 1}), k -> (shiftrightunsigned({mask}, k) & 1L) = 1L), k -> struct({leaf} AS leaf, k AS place))")
    both = pairs.select("i", "j", F.explode(members("i", "x")).alias("m")).unionByName(pairs.where("i <> j").select("i", "j", F.explode(members("j", "y")).alias("m")))
    dealt = both.select("i", "j", "m.leaf", "m.place").join(leaves.select("leaf", "place", "node", "component"), ["leaf", "place"]).join(sets.select("node", "hashes"), "node")
    dealt = dealt.repartition(n, "i", "j").sortWithinPartitions("i", "j", "leaf", "node")
    across = materialize(dealt.mapInArrow(_compare_nodes(percent), "a long, b long"), "across")
    discard(signed, labelled, leaves, nodes)
    return near, across


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; links: 100 * intersection >= percent * union."""
    texts = documents(docs, id_col, text_col)
    sketch = sketches(texts, words, percent)
    known = sketch.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("linkable").alias("linkable"))
    known = materialize(known.where("copies > 1 OR linkable"), "known")
    wanted = known.where("linkable").select(F.col("least").alias("doc_id"), "digest")
    ids = wanted.select("doc_id").distinct()
    few = wanted.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_set_rows(words), "doc_id long, digest binary, hashes binary, low long, high long")
    chosen = chosen.join(wanted, ["doc_id", "digest"], "left_semi").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("hashes", "low", "high")))
    sets = materialize(chosen.select(F.monotonically_increasing_id().alias("node"), "digest", (F.octet_length("hashes") / 8).cast("long").alias("n"), "hashes", "low", "high"), "sets")
    name = sets.join(known, "digest").select("node", "least")
    tables = links_of_sets(sets, percent)
    found = tables[0].unionByName(tables[1])
    edges = found.join(name.withColumnsRenamed({"node": "a", "least": "x"}), "a").join(name.withColumnsRenamed({"node": "b", "least": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # rows that repeat a doc_id with other sets connect what each of them is connected with
    counted = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    twice = materialize(counted.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id"), "twice")
    repeat = not twice.isEmpty()
    if repeat:
        edges = edges.unionByName(counted.join(twice, "doc_id").join(known, "digest").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct())
    joined = components(edges)
    discard(sets, *tables)
    label = known.join(joined.withColumnRenamed("node", "least"), "least", "left").select("digest", F.coalesce("component", "least").alias("label"))
    rows = sketch.withColumn("key", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest"))).join(label.withColumnRenamed("digest", "key"), "key", "left")
    if not repeat:
        return rows.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    own = joined.join(twice, F.col("node") == F.col("doc_id"), "left_semi").select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    return rows.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "label", "doc_id").alias("component_id"))
