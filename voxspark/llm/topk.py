"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt into blocks. A block has one sorted list a component, built once and shared by all
queries: a query reads it from the top where its own component is positive, from the bottom where it
is negative, so that each list gives the candidates by falling share of the score. All lists are read
in step, ``1 / STEPS`` of them at a time and never out of order. A candidate's lower bound takes what has
been read of it and the least value of each list where it hasn't been met; its upper bound takes the
value at which that list stands. The k-th lower bound, of this block or of the ones before, is what
outsiders must reach. Reading stops when no candidate that is unseen in all lists can, and few others; the
final scores of these are resolved and ordered by (score descending, id). Query blocks and groups of
candidate blocks meet by an equality join on both numbers, each task keeping its queries' best scores
from block to block; a last selection merges the groups.

Vectors without structure in many components make any such reading long: on the test tables' 64 it
goes through most of each list.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part;
vectors meet only vectors of their own length; a query's own row, by id, is no candidate; rows that
repeat an id are candidates each, and repeated query ids are one query (one of its vectors); fewer
candidates than k are all returned; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxspark.llm.common import discard, materialize

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
GROUP = 8
STEPS = 16


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(factor * x); rows without a usable vector are left out."""
    v = F.transform(table[vector_col], lambda x: x.cast("double"))
    usable = table[vector_col].isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(usable & table[id_col].isNotNull()).select(table[id_col].cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * factor)).alias("v"))


class Lists:
    """A block's vectors and, for each component, their places by rising value."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.rank = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.rank, self.order, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)


def nra(lists: Lists, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, tally: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each query (its place) the places of all candidates that may be among its best k.

    own[c, q]: candidates that don't count. floor: scores that the best k reach already, of other
    blocks. tally gets the number of entries read.
    """
    n, step = len(lists.v), max(k, -(-len(lists.v) // STEPS))
    low, high, left = lists.sorted[0][:, None], lists.sorted[-1][:, None], np.arange(len(queries))
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T  # by component and query
    lower = np.repeat((up * low + down * high).sum(axis=0)[None, :], n, axis=0)
    lower[own] = -np.inf
    for start in range(0, n, step):
        stop = min(n, start + step)
        # the next entries of every list, from both ends, for all queries at once
        top, bottom = (lists.rank >= n - stop) & (lists.rank < n - start), (lists.rank >= start) & (lists.rank < stop)
        lower += np.where(top, lists.v - low.T, 0) @ up + np.where(bottom, lists.v - high.T, 0) @ down
        if tally is not None:
            tally.append((stop - start) * lists.v.shape[1] * len(left))
        if n > k:
            floor = np.maximum(floor, np.partition(lower, n - k, axis=0)[n - k])
        if stop == n:
            may = lower >= floor
            may &= lower > -np.inf
            yield from ((q, np.flatnonzero(may[:, i])) for i, q in enumerate(left))
            return
        next_top, next_bottom = lists.sorted[n - 1 - stop][:, None], lists.sorted[stop][:, None]
        ready = np.flatnonzero((up * next_top + down * next_bottom).sum(axis=0) < floor)
        if not len(ready):
            continue
        # where a list hasn't met a candidate yet, its value may be as good as where the list stands
        unread = (lists.rank < n - stop).astype(lists.v.dtype) @ (up[:, ready] * (next_top - low))
        unread += (lists.rank >= stop).astype(lists.v.dtype) @ (down[:, ready] * (next_bottom - high))
        may = lower[:, ready] + unread >= floor[ready]
        ended = may.sum(axis=0) <= max(8 * k, step)
        yield from ((left[q], np.flatnonzero(may[:, i])) for i, q in enumerate(ready) if ended[i])
        stay = np.setdiff1d(np.arange(len(left)), ready[ended])
        left, up, down, lower, floor = left[stay], up[:, stay], down[:, stay], lower[:, stay], floor[stay]
        if not len(left):
            return


class Best:
    """The best k scores so far of the queries of a block."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores = k, np.full((queries, k), -np.inf)

    def floor(self) -> np.ndarray:
        return self.scores.min(axis=1)

    def add(self, query: int, scores: np.ndarray) -> None:
        self.scores[query] = np.sort(np.concatenate([self.scores[query], scores]))[-self.k :]


def top_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, lists: Lists, best: Best) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query those of its best k so far that the block has: query id, candidate ids, scores."""
    own = c_ids[:, None] == q_ids[None, :]
    for i, places in nra(lists, q, own, best.k, best.floor()):
        places = places[~own[places, i]]
        scores, ids = lists.v[places] @ q[i], c_ids[places]
        first = np.lexsort((ids, -scores))[: best.k]
        first = first[scores[first] >= best.scores[i].min()]
        if len(first):
            best.add(i, scores[first])
            yield q_ids[i], ids[first], scores[first]


def _search(k: int):
    """Rows sorted by (dim, q, g, c); a task holds one query block and one candidate block at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q, c = (np.asarray(x).reshape(-1, row.dim) for x in (row.q_v, row.c_v))
                exact = float(abs(q).max()) * float(abs(c).max()) * row.dim < 2**53  # doubles hold these sums exactly
                q, c = (x.astype(np.float64 if exact else np.longdouble) for x in (q, c))
                if (row.dim, row.q, row.g) != key:
                    key, best = (row.dim, row.q, row.g), Best(len(q), k)
                found = [*top_of_block(np.asarray(row.q_ids), q, np.asarray(row.c_ids), Lists(c), best)]
                if found:
                    sizes = [len(f[1]) for f in found]
                    yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], sizes), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found]).astype(np.int64)})

    return run


def top_k(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of table."""
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vector_col).withColumn("dim", F.size("v"))
    wanted = integer_vectors(queries, id_col, vector_col).withColumn("dim", F.size("v")).dropDuplicates(["vec_id"])

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        """Rows by their place in a written table, so that no id or vector makes a large block; and the number of blocks."""
        rows = materialize(df, f"{name}-rows")
        n = max(1, -(-rows.count() // size))
        place = F.monotonically_increasing_id()
        dealt = rows.withColumn(name, F.pmod(F.shiftright(place, 33) * 977 + place.bitwiseAND((1 << 33) - 1), F.lit(n)).cast("int"))
        found = materialize(dealt.groupBy("dim", name).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_v")), f"{name}-blocks")
        discard(rows)
        return found, n

    q_blocks, n_q = blocks(wanted, QUERY_BLOCK, "q")
    c_blocks, n_c = blocks(vectors, CANDIDATE_BLOCK, "c")
    groups = -(-n_c // GROUP)
    left = c_blocks.withColumn("g", (F.col("c") % groups).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = q_blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = left.join(right, ["dim", "q", "g"]).repartition(max(1, min(n_q * groups, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "dim", "q", "g")
    found = pairs.sortWithinPartitions("dim", "q", "g", "c").mapInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
