"""The Merkle manifest against a plain model of the trees."""

import hashlib
import zlib

import pytest

from voxspark.llm import merkle

SF = "/root/testdata/sf0.001"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    """Root, and each leaf's siblings to the left and right by level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(places):
            first = p // arity * arity
            paths[i].append((level[first:p], level[p + 1 : first + arity]))
            places[i] = p // arity
        level = [h("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def model(rows, arity=3):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append((r, h("".join(map(field, r)))))
    for rows_of in groups.values():
        rows_of.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([leaf for _, leaf in x], arity) for g, x in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, upper = tree([trees[g][0] for g in order], arity)
    for g, above in zip(order, upper, strict=True):
        for (r, leaf), below in zip(groups[g], trees[g][1], strict=True):
            steps = below + above
            proof = h("".join("".join(a) + "".join(b) for a, b in steps))
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = h("".join(map(field, (*r[:4], r[4] and r[4].replace("\n", "")))))
            for a, b in steps:
                node = h("".join(a) + node + "".join(b))
            out.append((r[0], leaf, trees[g][0], root, proof, node, node == root))
    return out


def ranked(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ranked(merkle.merkle_manifest(docs).collect()) == ranked(model([tuple(r) for r in docs.select(FIELDS).collect()]))


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_odd_rows(spark, arity):
    rows = [(None, None, "x", 1, "a\nb"), (1, None, None, None, None), (1, None, None, None, None), (2**60 + 1, "b", "x", 2, "é\n"), (2**60 + 2, "b", "x", 2, "\n" * 9)]
    rows += [(5, "c", "x", 2, ""), (7, "b", None, 2, "q"), (7, "b", None, 2, "r"), (8, "", "y", 0, "long\n" * 50_000)] + [(i, "hot", "l", i, f"{i}\n") for i in range(60)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame([(*r, "t", 1, "i") for r in rows], f"{schema}, tree string, idx long, leaf string").repartition(3)
    assert ranked(merkle.merkle_manifest(docs, arity=arity).collect()) == ranked(model(rows, arity))


def test_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.merkle_manifest(spark.createDataFrame([], schema)).collect() == []
    one = [(3, None, "en", 1, "x")]
    assert ranked(merkle.merkle_manifest(spark.createDataFrame(one, schema)).collect()) == ranked(model(one))
