"""What the operators share: the shared scratch folder, table reading, text defaults."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session has none and runs on one machine, as in tests, a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-voxspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/voxspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing to come reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def joinable(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The table, broadcast if it has so few narrow rows; beyond that joins shuffle both sides."""
    return F.broadcast(table) if table.count() <= rows else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column as string, null counting as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string not null); other columns, whatever their names, stay behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in order, few at a time, so that neither a worker's lists of them nor what goes back to the executor grow with Spark's batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()  # workers stay for the next tasks


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that compression finds the empty ones."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()
