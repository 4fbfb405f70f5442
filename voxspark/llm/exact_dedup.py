"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch (the Misra-Gries family, ``approx_top_k``) names digests that may be
frequent. Their exact counts and winners are verified in a second aggregation, which is at most
``counters`` rows, and broadcast, so the rows of frequent digests never shuffle. All other digests
have fewer rows than rows / counters and go through an ordinary shuffle: their winners come from
partial aggregates and meet the rows in a join, so no group is ever held.

Defined results: null text equals the empty text; empty texts are copies of each other; rows that
repeat a doc_id count as rows of their group, and all rows of the winning doc_id are kept; a group
whose doc_ids are all null has a null keep_id and keeps its rows; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import documents, materialize


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each input row."""
    base = documents(docs, id_col, text_col).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    base = materialize(base, "digests")
    sketch = base.agg(F.expr(f"approx_top_k(digest, {counters}, {8 * counters})").alias("top"))
    suspects = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))
    stats = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = base.join(F.broadcast(suspects), "digest", "left_semi").groupBy("digest").agg(*stats).where("group_size > 1")
    winners = materialize(winners.coalesce(1), "winners")
    heavy = base.join(F.broadcast(winners), "digest")
    rest = base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.join(rest.groupBy("digest").agg(*stats), "digest").select("digest", "doc_id", "keep_id", "group_size")
    return heavy.select(rest.columns).unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
