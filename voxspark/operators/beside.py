"""A one-row table beside every row, without a key that all rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many listed items the one row is broadcast.
BROADCAST_ITEMS = 10_000


def beside(rows: DataFrame, listed: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of `one`, a single row made of the rows of `listed`.

    A row of few items is broadcast; a longer one is repeated once a partition and joined on the partition's
    number, so that no task gets all rows.
    """
    key, n = "__beside", max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if listed.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS:
        return rows.withColumn(key, F.lit(0)).join(F.broadcast(one.withColumn(key, F.lit(0))), key).drop(key)
    spread = one.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn(key, F.pmod(F.spark_partition_id(), F.lit(n))).join(spread, key).drop(key)
