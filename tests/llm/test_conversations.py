"""Repair of conversations against a search over all edit scripts."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from voxspark.llm import conversations as C
from voxspark.llm.common import read_table

SF = "/root/testdata/sf0.01"
sys.setrecursionlimit(20_000)
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}


def best(codes):
    """Least (cost, audit) over all edits, as a walk through the grammar's phases."""

    @lru_cache(None)
    def f(i, phase, inserted):
        found = [(0, "")] if i == len(codes) and phase in (0, 3) else []
        letter, after = NEXT[phase]

        def add(cost, edit, rest):
            found.append((cost + rest[0], edit + rest[1]))

        if inserted < 4:
            add(2, "I", f(i, after, inserted + 1))
        if i < len(codes):
            add(3, "D", f(i + 1, phase, 0))
            role, cut = codes[i].lower(), int(codes[i].isupper())
            if role not in "bd":
                add(cut + 2 * (role != letter), "K" if role == letter else "R", f(i + 1, after, 0))
                if phase == 0 and role == "s":
                    add(cut, "K", f(i + 1, 1, 0))
        return min(found, default=(10**9, "~"))

    return f(0, 0, 0)


def texts(rng):
    for k in range(800):
        letters = rng.choice(["sua", "suaSUAbdx", "ua", "uaUA", "bdsS", "aaaus", "x", "uuuub", "bbbsu"])
        yield k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))


def test_alignment():
    for _, codes in texts(random.Random(3)):
        assert C.align(codes)[:2] == best(codes), codes


def test_blocks_chain():
    rng = random.Random(4)
    for _, codes in texts(rng):
        size = rng.choice([1, 2, 3, 5])
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        worth = [C.ENDS]
        for part in reversed(parts):
            c, after = C.costs(part), worth[-1]
            worth.append(tuple(min(C.INF, *(c[4 * p + q] + after[q] for q in range(4))) for p in range(4)))
        worth.reverse()
        phase, audit = 0, ""
        for k, part in enumerate(parts):
            _, more, phase = C.align(part, phase, worth[k + 1])
            audit += more
        assert (worth[0][0], audit) == best(codes), codes


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def model(rows, ids):
    by = {conv: [] for conv in ids}
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        seen, codes = set(), ""
        for _, _, role, text in turns:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "b" if not last else "d" if (role, text) in seen else code if last in ".!?" else code.upper()
            seen.add((role, text))
        cost, audit = best(codes)
        said, at = [], iter(turns)
        for edit in audit:
            due = "assistant" if said and said[-1][0][:1] == "u" else "user"
            if edit == "I":
                said.append((due, ""))
                continue
            _, _, role, text = next(at)
            if edit != "D":
                said.append((due if edit == "R" else role, text))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (conv, gaps, codes.count("b"), codes.count("d"), sum(c.isupper() for c in codes), illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("size", [3, 1024])
def test_whole_table(spark, size):
    table = read_table(spark, SF, "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r) for r in C.repair_report(C.damage(table), table, size).collect()}
    assert got == model(damaged(rows), {r[0] for r in rows})


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (2**60 + 1, 5, "tool", "x"), (2**60 + 2, None, "", "y."), (3, 1, "system", "S."), (3, 1, "user", "é 日本\n"), (3, 1, "user", "é 日本\n"), (4, 10**12, "assistant", "end. \t\n" * 40_000)]
    rows += [(7, rng.randint(0, 300), rng.choice(["user", "assistant", "system", "uncle", "x"]), rng.choice(["A.", "b", " ", f"t{rng.random()}!"])) for _ in range(300)]
    wide = [(*r, 1, "k", "c", [1]) for r in rows]
    df = spark.createDataFrame(wide, f"{SCHEMA}, g long, kind string, codes string, audits array<long>").repartition(3)
    want = model(damaged(rows), {r[0] for r in rows})
    for size in (16, 1024):
        assert {r.conv_id: tuple(r) for r in C.repair_report(C.damage(df), df, size).collect()} == want
    turns = C.repaired_turns(C.damage(df)).where("conv_id = 7").orderBy("position").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns)) and [r.position for r in turns] == [*range(len(turns))]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(C.damage(none), none).collect() == []
    ids = spark.createDataFrame([(1,)], "conv_id long")
    assert C.repair_report(none, ids).collect()[0][1:8] == (0, 0, 0, 0, 0, 0, "")
