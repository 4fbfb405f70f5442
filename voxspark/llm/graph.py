"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import discard, materialize


def _is_star(edges: DataFrame) -> bool:
    """Whether every node u has one v and no v is a u."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("root")).distinct(), F.col("u") == F.col("root"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), component being the smallest node it reaches.

    Minima are pre-aggregated, and hub nodes meet their edges in joins that Spark can split. Only two
    answers, whether anything is left, reach the driver in a round.
    """
    stars = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_star(stars):
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that a hub's rows are in a join that Spark can split
        minima = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(minima, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = stars
        stars = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(before, minima)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
