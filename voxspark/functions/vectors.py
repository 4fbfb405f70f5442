"""Vector arithmetic in doubles on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, not once for each use inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm where that is over 1e-10; null for null or empty."""
    unit = let(norm(v), lambda n: F.when(n > 1e-10, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v)))
    return F.when(v.isNotNull() & (F.size(v) > 0), unit)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for null, different lengths or a zero norm."""
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    both = norm(a) * norm(b)
    return F.when(fits & (both > 0), dot(a, b) / both).otherwise(0.0)


def softmax(v: Column) -> Column:
    shifted = let(F.array_max(doubles(v)), lambda m: F.transform(doubles(v), lambda x: F.exp(x - m)))
    return let(shifted, lambda e: let(_sum(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(v: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def blend_centroid(c: Column, n: Column, x: Column) -> Column:
    """The centroid of n vectors with one more, normalised."""
    return let(F.zip_with(doubles(c), l2_normalize(x), lambda a, b: (a * n + b) / (n + 1)), l2_normalize)


def unblend_centroid(c: Column, n: Column, x: Column, enrolled: Column) -> Column:
    """The reverse; an enrolled or last vector's centroid stays."""
    back = let(F.zip_with(doubles(c), l2_normalize(x), lambda a, b: (a * n - b) / (n - 1)), l2_normalize)
    return F.when(enrolled | (n <= 1), doubles(c)).otherwise(back)


#: Speakers of the seven classes of a segmentation model.
POWERSET = [[], [0], [1], [2], [0, 1], [0, 2], [1, 2]]


def powerset_speakers(cls: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(s) for s in c]).cast("array<int>") for c in POWERSET])
    return F.when(cls.between(0, 6), F.get(table, cls))


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Element-wise mean for each key; partial sums are combined before the shuffle."""
    long = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(doubles(F.col(vector))).alias("__dim", "__x"))
    sums = long.groupBy(*keys, "__dim").agg(F.avg("__x").alias("__x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__dim", "__x"))), lambda s: s["__x"]).alias(out))
