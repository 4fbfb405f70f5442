"""How well embeddings separate speakers; projections for plots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.functions import vectors as V
from voxspark.operators.beside import beside
from voxspark.operators.speakers import enrollment_pairs


def mean_pairwise_similarity(roster: DataFrame, keys: list[str]) -> DataFrame:
    return enrollment_pairs(roster, keys).groupBy(*keys).agg(F.avg("similarity").alias("mean_similarity"))


def most_confusable_pair(roster: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("similarity")).alias("m"), "idx_a", "idx_b", "name_a", "name_b"))
    return enrollment_pairs(roster, keys).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.name_a").alias("name_a"), F.col("b.name_b").alias("name_b"), (-F.col("b.m")).alias("similarity"))


def silhouette(samples: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Cosine silhouette for each key from cluster sums: the mean cosine to a cluster is the inner product with its mean unit vector."""
    unit = samples.withColumn("__u", V.l2_normalize(F.col("embedding")))
    mean = V.mean_vector(unit, [*keys, cluster], "__u", "__m").join(unit.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("__n")), [*keys, cluster])
    lists = mean.groupBy(*keys).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("__m").alias("m"), F.col("__n").alias("n"))).alias("__all"))
    rows = unit.join(lists, keys) if keys else beside(unit, mean, lists)
    own = F.get(F.filter("__all", lambda s: s["c"] == F.col(cluster)), F.lit(0))
    distance = lambda s: 1 - V.dot(F.col("__u"), s["m"])
    others = F.filter("__all", lambda s: s["c"] != F.col(cluster))
    b = F.array_min(F.transform(others, distance))
    a = F.when(own["n"] > 1, distance(own) * own["n"] / (own["n"] - 1)).otherwise(0.0)
    high = F.greatest(a, b)
    value = F.when(high > 0, (b - a) / high).otherwise(0.0)
    enough = (F.size("__all") > 1)
    return rows.select(*keys, F.when(enough, value).alias("__s")).groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, F.avg("__s")).alias("silhouette")).select(*keys, "silhouette")


def simplified_silhouette(roster: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over clusters of the cosine distance to the nearest other centroid, less 1."""
    pairs = enrollment_pairs(roster, keys)
    both = pairs.select(*keys, F.col("idx_a").alias("i"), "similarity").unionByName(pairs.select(*keys, F.col("idx_b").alias("i"), "similarity"))
    return both.groupBy(*keys, "i").agg((1 - F.max("similarity")).alias("d")).groupBy(*keys).agg((F.avg("d") - 1).alias("silhouette"))


def discriminability_report(samples: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    """One row a model: mean and greatest similarity of its speakers and a silhouette, the simplified one if a speaker has one sample."""
    single = samples.groupBy(key, "idx").count().groupBy(key).agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("n_speakers"))
    rows = single.join(mean_pairwise_similarity(roster, [key]), key, "left").join(most_confusable_pair(roster, [key]), key, "left")
    rows = rows.join(silhouette(samples, [key], "idx"), key, "left").join(simplified_silhouette(roster, [key]).withColumnRenamed("silhouette", "__simple"), key, "left")
    return rows.select(key, "n_speakers", "mean_similarity", "name_a", "name_b", F.col("similarity").alias("max_similarity"), F.when(F.col("least") > 1, F.col("silhouette")).otherwise(F.col("__simple")).alias("silhouette"))


def vector_diagnostics(df: DataFrame, vector: str = "embedding") -> DataFrame:
    v = V.doubles(F.col(vector))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return df.withColumns({"dim": F.size(v), "norm": V.norm(F.col(vector)), "mean": mean, "least": F.array_min(v), "most": F.array_max(v)})


def pca_2d(df: DataFrame, id_col: str, vector: str = "embedding", iterations: int = 100) -> DataFrame:
    """(id, x, y): projection on the two leading directions of the centred vectors.

    Partial sums of the Gram matrix are made in tasks; only a d x d matrix reaches the driver.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
                gram = x.T @ x + (0 if gram is None else gram)
        if n:
            yield pd.DataFrame({"i": range(len(total) + 1), "row": [[float(n)], *[[*g, t] for g, t in zip(gram.tolist(), total.tolist(), strict=True)]]})

    rows = df.select(F.col(id_col), V.doubles(F.col(vector)).alias("v")).where("v IS NOT NULL")
    parts = rows.select("v").mapInPandas(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    sums = {(r["i"], r["j"]): r["x"] for r in parts.collect()}
    if not sums:
        return rows.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n, d = sums[0, 0], max(i for i, _ in sums)
    full = np.array([[sums[i + 1, j] for j in range(d + 1)] for i in range(d)])
    mean = full[:, d] / n
    cov = full[:, :d] - n * np.outer(mean, mean)
    axes = []
    for c in range(2):
        i = np.arange(d)
        v = np.sin(0.1 * i * (c + 1)) + np.cos(0.05 * i)
        v /= np.linalg.norm(v)
        for _ in range(iterations):
            w = cov @ v
            for a in axes:
                w = w - (w @ a) * a
            length = np.linalg.norm(w)
            if length < 1e-10:
                break
            v = w / length
        axes.append(v)
    centred = F.zip_with("v", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    along = lambda a: F.lit(0.0) if n < 2 else V.dot(centred, F.array(*[F.lit(float(x)) for x in a]))
    return rows.select(id_col, along(axes[0]).alias("x"), along(axes[1]).alias("y"))


