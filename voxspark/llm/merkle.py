"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf, the hash of its fields. Rows are numbered within their group by range
partitioning: a row's place in its range, less where its group begins there, plus the group's rows in
the ranges before, so that a hot group spreads over many tasks. At every level slot-zero nodes equijoin
the nodes at their sibling indices (index XOR 1 in binary trees, index + slot otherwise) and emit the
parents; all groups' trees climb together, one join a level on the unique (tree, index). Subroots are
numbered and joined in the same way up to the root. Proofs come down level by level: a parent's steps
go to its children, each with its own siblings put in front, so a level moves a third of the rows of
the one below.

Defined results: each null field counts as "-"; rows with a null group form a group of their own,
sorted first; null ids come first, equal ids are ordered by their leaf; repeated rows are leaves each;
rows with a null id are never tampered with; an empty table has no rows and no root; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.llm.common import discard, materialize, partitions

DIGEST = 32
STEPS = "array<struct<l:binary,r:binary>>"


def field(value: Column) -> Column:
    """A field as text: "-" for null, else the UTF-8 length, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds idx, the row's number in its tree by `order`, and n, the tree's rows. Trees sort nulls first."""
    by = [tree, *order]
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    spread = materialize(spread.withColumn("__g", F.monotonically_increasing_id()), f"{name}-ranges")
    bucket = F.shiftright("__g", 33)
    parts = spread.groupBy(bucket.alias("__b"), F.col(tree).alias("__t")).agg(F.min("__g").alias("__first"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy("__t")
    before = F.sum("__n").over(own.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__b", "__t", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(own).alias("n"))
    found = spread.join(parts, (bucket == parts["__b"]) & spread[tree].eqNullSafe(parts["__t"]))
    found = found.withColumn("idx", F.col("__g") - F.col("__first") + F.col("__before"))
    found = materialize(found.select(*rows.columns, "idx", "n"), name)
    discard(spread)
    return found


def climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Parents of each level from the leaves up: tree, idx, n, hash, kids (their children's digests, concatenated).

    nodes: tree, idx, n (of its tree), hash. Trees of one node have no parents.
    """
    highest, levels, level = nodes.agg(F.max("n")).first()[0] or 0, [], nodes
    while highest > 1:
        level = level.where("n > 1")
        slot = F.col("idx") % arity
        heads, kids = level.where(slot == 0), [F.col("hash")]
        for d in range(1, arity):
            shifted = F.col("idx").bitwiseXOR(1) if arity == 2 else F.col("idx") - d
            other = level.where(slot == d).select(F.col("tree").alias("__t"), shifted.alias("__i"), F.col("hash").alias(f"__h{d}"))
            heads = heads.join(other, heads["tree"].eqNullSafe(other["__t"]) & (heads["idx"] == other["__i"]), "left").drop("__t", "__i")
            kids.append(F.coalesce(f"__h{d}", F.lit(b"")))
        up = heads.select("tree", F.expr(f"idx div {arity}").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.concat(*kids).alias("kids"))
        up = materialize(up.withColumn("hash", digest(hexed(F.col("kids")))), f"level-{len(levels) + 1}")
        levels.append(up)
        level, highest = up, -(-highest // arity)
    return levels


def roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, height, hash of each tree's last node."""
    found = [level.where("n = 1").select("tree", F.lit(k).alias("height"), "hash") for k, level in enumerate([nodes, *levels])]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def step(kids: Column, slot: Column) -> Column:
    """Siblings to the left and right of a child, as one array of one struct."""
    at = (slot * DIGEST).cast("int")
    part = lambda start, size: F.substring(kids, start, size)
    rest = F.octet_length(kids)
    return F.array(F.struct(part(F.lit(1), at).alias("l"), part(at + DIGEST + 1, rest).alias("r")))


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """nodes with the steps from each to what `tops` (tree, height, steps and more columns) holds of its tree."""
    more = [c for c in tops.columns if c not in ("tree", "height", "steps")]
    top = lambda k: tops.where(F.col("height") == k).select(F.col("tree").alias("__t"), F.lit(0).cast("long").alias("__i"), "steps", *more)
    at = top(len(levels))
    for k in range(len(levels), 1, -1):
        run = levels[k - 1].select("tree", "idx", "kids")
        run = run.join(at, run["tree"].eqNullSafe(at["__t"]) & (run["idx"] == at["__i"]))
        slots = F.explode(F.sequence(F.lit(0), (F.octet_length("kids") / DIGEST - 1).cast("int")))
        run = run.select("*", slots.alias("__slot"))
        own = F.concat(step(F.col("kids"), F.col("__slot")), F.col("steps")).alias("steps")
        at = run.select(F.col("tree").alias("__t"), (F.col("idx") * arity + F.col("__slot")).alias("__i"), own, *more).unionByName(top(k - 1))
    lone = nodes.where("n = 1")
    own = top(0)
    found = lone.join(own, lone["tree"].eqNullSafe(own["__t"])).drop("__t", "__i")
    if not levels:
        return found
    run = levels[0].select(F.col("tree").alias("__rt"), F.col("idx").alias("__ri"), "kids")
    run = run.join(at, run["__rt"].eqNullSafe(at["__t"]) & (run["__ri"] == at["__i"])).drop("__t", "__i")
    many = nodes.where("n > 1")
    # a third as many rows of steps move as if each child had its own
    many = many.join(run, many["tree"].eqNullSafe(run["__rt"]) & (F.expr(f"idx div {arity}") == run["__ri"]))
    many = many.withColumn("steps", F.concat(step(F.col("kids"), F.col("idx") % arity), F.col("steps"))).drop("__rt", "__ri", "kids")
    return many.unionByName(found)


def fold(leaf: Column, steps: Column) -> Column:
    """Root that a leaf's hash (hex) and its steps give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(hexed(s["l"]), acc, hexed(s["r"])), 256))


def merkle_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    text_col: str = "text",
    arity: int = 3,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    The audit tampers with the rows whose id's CRC-32 is even: their text loses its newlines. folded_root
    is recomputed from what the row's leaf has become and the original siblings.
    """
    value = lambda c, new: field(new if c == text_col and new is not None else docs[c])
    leaf = lambda new=None: digest(F.concat(*[value(c, new) for c in fields]))
    bare = F.replace(docs[text_col].cast("string"), F.lit("\n"), F.lit(""))
    hit = F.crc32(docs[id_col].cast("string")) % 2 == 0
    leaves = docs.select(
        docs[group_col].cast("string").alias("tree"), docs[id_col].cast("long").alias("doc_id"),
        leaf().alias("hash"), F.when(hit, leaf(bare)).alias("other"), F.monotonically_increasing_id().alias("place"),
    )
    leaves = materialize(leaves, "leaves")
    nodes = numbered(leaves, "tree", ["doc_id", "hash", "place"], "nodes")
    discard(leaves)
    levels = climb(nodes.select("tree", "idx", "n", "hash"), arity)
    groups = roots(nodes, levels).select(F.lit(0).alias("all"), F.col("tree").alias("group"), "height", "hash")
    groups = numbered(groups, "all", ["group"], "groups").withColumnRenamed("all", "tree")
    upper = climb(groups.select("tree", "idx", "n", "hash"), arity)
    last = roots(groups, upper)
    first = last.select(hexed(F.col("hash"))).first()  # the one root
    root = F.lit(first and first[0]).cast("string")
    tops = last.select("tree", F.col("height"), F.array().cast(STEPS).alias("steps"))
    above = descend(groups.select("tree", "idx", "n", "group", F.col("height").alias("own"), "hash"), upper, tops, arity)
    above = above.select(F.col("group").alias("tree"), F.col("own").alias("height"), "steps", F.col("hash").alias("subroot"))
    if upper:
        above = materialize(above, "subroots")
    found = descend(nodes.select("tree", "idx", "n", "doc_id", "hash", "other"), levels, above, arity)
    proof = F.array_join(F.transform("steps", lambda s: hexed(F.concat(s["l"], s["r"]))), "")
    folded = fold(hexed(F.coalesce("other", "hash")), F.col("steps"))
    out = found.select("doc_id", hexed(F.col("hash")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
