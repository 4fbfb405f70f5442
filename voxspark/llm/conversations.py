"""Repair of conversations by alignment with the alternating grammar ``(s?(ua)+)?``.

A conversation's turns become one code each: blank, duplicate, or the role's initial, in upper case if
the text is truncated. The codes are aligned with every feasible target by Wagner and Fischer's table.
Targets of one kind (with or without a system turn) are prefixes of each other, so one table holds all
their lengths: its last row has what each length costs. Cells are kept in Ukkonen's band, the
diagonals that the incumbent's cost still allows, the incumbent being a plain walk without choices.
The backtraced audits of the kinds with least cost are compared.

A conversation of any length is dealt into blocks of at most BLOCK turns, by range partitioning on
(conversation, turn), so that a hot conversation spreads over tasks. A whole conversation is one block
and aligned at once. Blocks of others give their cost from each grammar phase to each; these few numbers
are chained a conversation, which fixes the phase at which each block begins and what its end is worth,
and the blocks are then traced in parallel. Texts stay in Spark until the last pass, which streams a
conversation's turns in order, with one block's audit and one hash state in memory; a hash over all
turns can't be computed in parts.

Defined results: a null role, text, id or turn counts as one space in what is hashed; null turns come
first and count in no gap; equal turns are ordered by role, the text's first 64 characters and its
digest; repeated rows are turns each (the second is a duplicate); turns of a null id form one
conversation; a role counts by its first character, an empty one fits nowhere; an empty table has no
rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import materialize, partitions

BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 28
#: Phases of the grammar: nothing yet, after the system turn, assistant next, user next after a pair.
PHASES, ENDS = 4, (0, INF, INF, 0)
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Phases that can follow each.
REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))


def target(entry: int, system: bool, size: int) -> tuple[str, np.ndarray]:
    """The longest target from a phase on, and the phase after each number of its letters (-1: not of this kind)."""
    letters = ("s" if system else "") + ("au" if entry == 2 else "ua") * (size // 2 + 1)
    first = [-1, 1] if system else [entry]
    last = len(letters) + 1 - len(first)
    next_ = [2, 3] if first[-1] != 2 else [3, 2]
    return letters, np.array([*first, *(next_ * (last // 2 + 1))[:last]])


def incumbent(codes: str, letters: str, worth: np.ndarray) -> int:
    """Cost of the cheaper of two plain ways: keep or rerole all that may stay, or delete all."""
    system, j, cost = letters[0] == "s", 0, 0
    for c in codes:
        if c in "bd" or (letters[j] == "s" and c not in "sS"):
            cost += DELETE
        else:
            cost += (KEEP if c.lower() == letters[j] else REROLE) + (TRUNCATED if c.isupper() else 0)
            j += 1
    best = min(cost + INSERT * k + int(worth[j + k]) for k in range(4)) if j or not system else INF
    if system:
        kept = min((TRUNCATED if c == "S" else 0 for c in codes if c in "sS"), default=INF)
        return min(best, DELETE * (len(codes) - 1) + kept + int(worth[1]))
    return min(best, DELETE * len(codes) + int(worth[0]))


def table(codes: str, letters: str, worth: np.ndarray, most: int) -> np.ndarray:
    """Least cost from (turns read, letters written) to the end; INF outside the band that `most` allows."""
    n, size = len(codes), len(worth)
    forced = np.frombuffer(codes.encode(), np.uint8)
    may = (forced != ord("b")) & (forced != ord("d"))
    read = np.concatenate([[0], np.cumsum(may)])  # turns that may stay, among the first
    slack = most - DELETE * int((~may).sum()) - int(worth.min())
    low = np.maximum(read - slack // DELETE, 0)
    high = np.minimum(read + slack // INSERT, size - 2) + 1
    found = np.full((n + 1, size + 1), INF, np.int64)
    climb = INSERT * np.arange(size + 1)
    fit = {c: np.array([KEEP if c == x else INF if x == "s" else REROLE for x in letters[:size]]) for c in set(codes.lower())}
    start = 1 if letters[0] == "s" else 0  # no system turn is inserted
    for i in range(n, -1, -1):
        a, b = int(low[i]), int(high[i])
        if a >= b:
            continue
        if i == n:
            row = worth[a:b].copy()
        else:
            row = found[i + 1, a:b] + DELETE
            if may[i]:
                c = codes[i]
                row = np.minimum(row, found[i + 1, a + 1 : b + 1] + fit[c.lower()][a:b] + (TRUNCATED if c.isupper() else 0))
        at = max(0, start - a)
        row[at:] = np.minimum.accumulate((row[at:] + climb[a + at : b])[::-1])[::-1] - climb[a + at : b]
        found[i, a:b] = np.minimum(row, INF)
    return found


def trace(codes: str, letters: str, found: np.ndarray, worth: np.ndarray) -> tuple[str, int]:
    """The ASCII-least of the cheapest audits, and how many letters it writes."""
    i, j, n, out = 0, 0, len(codes), []
    while i < n or found[i, j] != worth[j]:
        rest = found[i, j]
        if i < n and found[i + 1, j] + DELETE == rest:
            out.append("D")
            i += 1
        elif letters[j] != "s" and found[i, j + 1] + INSERT == rest:
            out.append("I")
            j += 1
        else:
            out.append("K" if codes[i].lower() == letters[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out), j


def kinds(codes: str, entry: int) -> list[bool]:
    return [False, True] if entry == 0 and ("s" in codes or "S" in codes) else [False]


def solved(codes: str, entry: int, system: bool, worth: tuple[int, ...]) -> tuple[int, str, np.ndarray, np.ndarray, np.ndarray]:
    """Least cost of one kind of target, with what tracing it takes."""

    def known(size: int) -> tuple[str, np.ndarray, np.ndarray]:
        letters, phases = target(entry, system, size)
        return letters, phases, np.where(phases < 0, INF, np.array(worth)[phases])

    letters, phases, value = known(len(codes) + 6)
    most = incumbent(codes, letters, value)
    if most >= INF:
        return INF, letters, phases, value, value
    # no target is longer than the turns and what the incumbent's cost can insert
    letters, phases, value = known(len(codes) + most // INSERT + 6)
    found = table(codes, letters, value, most)
    return int(found[0, 0]), letters, phases, value, found


def align(codes: str, entry: int = 0, worth: tuple[int, ...] = ENDS) -> tuple[int, str, int]:
    """Least cost, its ASCII-least audit, and the phase after it; worth: what ending in each phase costs."""
    runs = [solved(codes, entry, system, worth) for system in kinds(codes, entry)]
    least = min(r[0] for r in runs)
    audits = [(*trace(codes, letters, found, value), phases) for cost, letters, phases, value, found in runs if cost == least]
    audit, j, phases = min(audits, key=lambda x: x[0])
    return least, audit, int(phases[j])


@lru_cache(maxsize=20_000)
def audit_of(codes: str) -> str:
    """Audit of a whole conversation; the same few codes come again and again."""
    return align(codes)[1]


def costs(codes: str) -> list[int]:
    """A block's least cost from each phase to each, INF where there is no way."""
    out = [INF] * (PHASES * PHASES)
    for p in range(PHASES):
        for q in REACH[p]:
            worth = tuple(0 if k == q else INF for k in range(PHASES))
            out[PHASES * p + q] = min(solved(codes, p, system, worth)[0] for system in kinds(codes, p))
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text as the contract damages them, by the CRC-32 of "conv_id:turn" modulo 20."""
    spaced = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(hit == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))).alias("__copy")
    kept = rows.where(hit != 0)
    return kept.select("conv_id", kept["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies).drop("__copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with g, which grows along all conversations, a digest and a code without duplicates."""
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    whole = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(whole == "", "b").when(F.right(whole, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    said = said.select("*", code.alias("code"), digest.alias("digest"), F.left("text", F.lit(64)).alias("head"), F.monotonically_increasing_id().alias("place"))
    by = ["conv_id", "turn", "role", "head", "digest", "place"]
    spread = said.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return materialize(spread.drop("head", "place").withColumn("g", F.monotonically_increasing_id()), "turns")


def blocks_of(size: int):
    """Sorted (conv_id, g, code) to blocks: conv_id, g of the first turn, codes; a whole conversation's audit, else the block's costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, None, [], False]  # conv, first g, codes, whether it begins here for sure
        kind = None

        def closed(out: list, ends: bool) -> None:
            conv, first, codes, begins = held
            if codes:
                said = "".join(codes)
                whole = begins and ends
                out.append((conv, first, said, audit_of(said) if whole else None, None if whole else costs(said)))

        def batch(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "g", "codes", "audit", "costs"])

        for b in batches:
            kind, out = b.schema.field("conv_id").type, []
            for conv, g, code in zip(*(b.column(c).to_pylist() for c in ("conv_id", "g", "code")), strict=True):
                same_range = held[1] is not None and held[1] >> 33 == g >> 33
                if not same_range or conv != held[0]:
                    closed(out, same_range)
                    held[:] = [conv, g, [], same_range]
                elif len(held[2]) == size:
                    closed(out, False)
                    held[:] = [conv, g, [], False]
                held[2].append(code)
            yield batch(out)
        out = []
        closed(out, False)
        if out:
            yield batch(out)

    return run


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' costs, sorted by conversation and g, to the phase each begins in and what each phase at its end is worth."""

    def chain(part: list[tuple[int, list[int]]], out: list) -> None:
        worth = [ENDS]
        for _, c in reversed(part):
            after = worth[-1]
            worth.append(tuple(min(INF, *(c[PHASES * p + q] + after[q] for q in range(PHASES))) for p in range(PHASES)))
        worth.reverse()
        out.extend((g, list(worth[k + 1])) for k, (g, _) in enumerate(part))

    conv, part, begun = None, [], False
    for b in batches:
        out: list = []
        for other, g, c in zip(*(b.column(x).to_pylist() for x in ("conv_id", "g", "costs")), strict=True):
            if begun and other != conv:
                chain(part, out)
                part = []
            conv, begun = other, True
            part.append((g, c))
        yield pa.RecordBatch.from_pylist([{"g": g, "worth": w} for g, w in out], WORTH)
    out = []
    chain(part, out)
    yield pa.RecordBatch.from_pylist([{"g": g, "worth": w} for g, w in out], WORTH)


WORTH = pa.schema([("g", pa.int64()), ("worth", pa.list_(pa.int64()))])
FROM_EACH = pa.schema([("g", pa.int64()), ("audits", pa.list_(pa.string())), ("phases", pa.list_(pa.int64()))])


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's audit and last phase from every phase it could begin in."""
    for b in batches:
        out = []
        for g, codes, worth in zip(*(b.column(x).to_pylist() for x in ("g", "codes", "worth")), strict=True):
            runs = [align(codes, p, tuple(worth)) for p in range(PHASES)]
            out.append({"g": g, "audits": [a if c < INF else None for c, a, _ in runs], "phases": [q for _, _, q in runs]})
        yield pa.RecordBatch.from_pylist(out, FROM_EACH)


def plan(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, g, codes, audits, phases of each block; a whole conversation's block has one audit only."""
    n = partitions(turns.sparkSession)
    firsts = turns.where("code <> 'b'").groupBy("conv_id", "digest").agg(F.min("g").alias("__first")).select("__first")
    codes = turns.select("conv_id", "g", "code").join(firsts, F.col("g") == F.col("__first"), "left")
    code = F.when((F.col("code") != "b") & F.col("__first").isNull(), "d").otherwise(F.col("code"))
    codes = codes.select("conv_id", "g", code.alias("code")).repartition(n, F.shiftright("g", 33)).sortWithinPartitions("g")
    kind = turns.schema["conv_id"].dataType.simpleString()
    blocks = materialize(codes.mapInArrow(blocks_of(size), f"conv_id {kind}, g long, codes string, audit string, costs array<long>"), "blocks")
    parts = blocks.where("audit IS NULL")
    worth = parts.select("conv_id", "g", "costs").repartition(n, "conv_id").sortWithinPartitions("conv_id", "g").mapInArrow(chained, "g long, worth array<long>")
    found = parts.select("g", "codes").join(worth, "g").mapInArrow(traced, "g long, audits array<string>, phases array<long>")
    parts = parts.select("conv_id", "g", "codes").join(found, "g").select("conv_id", "g", "codes", "audits", "phases")
    whole = blocks.where("audit IS NOT NULL").select("conv_id", "g", "codes", F.array("audit").alias("audits"), F.lit(None).cast("array<long>").alias("phases"))
    return whole.unionByName(parts)


class Repair:
    """One conversation's turns in order, with its blocks' audits in between."""

    def __init__(self, conv):
        self.conv, self.phase, self.last = conv, 0, ""  # last: the letter written last
        self.audit, self.at, self.parts = "", 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before: str | None = None
        self.least = self.newest = None
        self.turns, self.written, self.hash = 0, 0, hashlib.sha256()

    def block(self, codes: str, audits: list[str], phases: list[int] | None) -> list[tuple[str, str]]:
        out = self.inserted()
        self.audit, self.at = audits[self.phase if phases else 0], 0
        self.phase = phases[self.phase] if phases else self.phase
        self.parts.append(self.audit)
        self.blank += codes.count("b")
        self.duplicate += codes.count("d")
        cut = [c.isupper() for c in codes]
        self.truncated += sum(cut)
        fates = self.audit.replace("I", "")
        self.cost += DELETE * fates.count("D") + REROLE * fates.count("R") + INSERT * (len(self.audit) - len(fates))
        self.cost += TRUNCATED * sum(c and f != "D" for c, f in zip(cut, fates, strict=True))
        return out

    def write(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written += 1
        self.last = role[:1]
        return role, text

    def due(self) -> str:
        return ROLES["a" if self.last == "u" else "u"]

    def inserted(self) -> list[tuple[str, str]]:
        """Turns that the audit puts in here."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            out.append(self.write(self.due(), ""))
            self.at += 1
        return out

    def turn(self, number: int | None, role: str, text: str) -> list[tuple[str, str]]:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if number is not None:
            self.turns += number != self.newest
            self.least, self.newest = number if self.least is None else self.least, number
        out, fate = self.inserted(), self.audit[self.at]
        self.at += 1
        return out if fate == "D" else [*out, self.write(self.due() if fate == "R" else role, text)]

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.newest - self.least + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.parts), self.hash.hexdigest())


REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
REPORT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def stream(reports: bool):
    """Conversations one after the other, each as its id, then blocks and their turns by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        fields = None

        def batch(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [c for c, _ in fields])

        def said(out: list, turns: list[tuple[str, str]]) -> None:
            if not reports:
                first = now.written - len(turns)
                out.extend((now.conv, first + k, *t) for k, t in enumerate(turns))

        def ended(out: list) -> None:
            if now is not None:
                said(out, now.inserted())
                if reports:
                    out.append(now.row())

        for b in batches:
            fields = [("conv_id", b.schema.field("conv_id").type), *(REPORT if reports else REPAIRED)]
            out: list = []
            names = ("conv_id", "kind", "turn", "role", "text", "codes", "audits", "phases")
            for conv, kind, turn, role, text, codes, audits, phases in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if now is None or conv != now.conv:
                    ended(out)
                    now = Repair(conv)
                if kind == 1:
                    said(out, now.block(codes, audits, phases))
                elif kind == 2:
                    said(out, now.turn(turn, role, text))
            yield batch(out)
        if now is not None:
            out = []
            ended(out)
            yield batch(out)

    return run


def _streamed(rows: DataFrame, ids: DataFrame, size: int, reports: bool) -> DataFrame:
    turns = in_order(rows)
    none = lambda kind: F.lit(None).cast(kind)
    nothing = {"turn": "long", "role": "string", "text": "string", "codes": "string", "audits": "array<string>", "phases": "array<long>"}
    shape = lambda df, kind: df.select("conv_id", "g", F.lit(kind).alias("kind"), *[df[c] if c in df.columns else none(t).alias(c) for c, t in nothing.items()])
    heads = ids.select(ids["conv_id"].cast(turns.schema["conv_id"].dataType).alias("conv_id")).distinct().withColumn("g", F.lit(-1).cast("long"))
    parts = shape(heads, 0).unionByName(shape(plan(turns, size), 1)).unionByName(shape(turns, 2))
    dealt = parts.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "g", "kind")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(stream(reports), f"conv_id {kind}, {REPORT_DDL if reports else 'position long, role string, text string'}")


def repair_report(rows: DataFrame, ids: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    rows: conv_id, turn, role, text. ids: a table whose conv_ids each get a row, also those without turns.
    """
    return _streamed(rows, rows if ids is None else ids, size, True)


def repaired_turns(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations."""
    return _streamed(rows, rows, size, False)
