"""Tables in versions: folders first, one pointer file last.

A version's pointer names, for each table and bucket, the folder that holds its rows. A write makes
folders for the buckets it touches and publishes its pointer by a rename once all tables are written, so
readers see all of a version or none of it, and a failed write leaves the version before readable. To
publish a version again does nothing: a streaming batch that is tried again is not applied twice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


@dataclass(frozen=True)
class Table:
    """schema: DDL of the rows; keys: what tells rows apart; bucket_by: the column, among them, whose hash picks a row's bucket."""

    schema: str
    keys: tuple[str, ...]
    bucket_by: str = "recording_id"


class Store:
    """Several tables that change together."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = 16):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def pointer(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """Folders by table and bucket of a version, of the newest if none is given."""
        known = self.versions()
        if not known:
            return {}
        stream = self._fs.open(self._path(f"{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/{name}")

    def _publish(self, version: int, pointer: dict) -> None:
        draft = self._path(f"_{version}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{version}.json")):
            raise OSError(f"version {version} of {self.path} can't be published")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows in a version, in the newest if none is given."""
        return self._rows(table, [*self.pointer(version).get(table, {}).values()])

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.tables[table].schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(F.col(self.tables[table].bucket_by).cast("string")), F.lit(self.buckets)).cast("int")

    def publish(self, version: int, upserts: dict[str, DataFrame], deletes: dict[str, DataFrame] | None = None) -> None:
        """A new version: rows of `deletes` (their keys) go, rows of `upserts` come or replace those with their keys.

        Frames are read several times, so they should be written tables. Of rows that repeat a key in `upserts` one stays.
        """
        if version in self.versions():
            return
        pointer, deletes = self.pointer(), deletes or {}
        for table in sorted({*upserts, *deletes}):
            t, bucket = self.tables[table], self._bucket(table)
            columns = self.spark.createDataFrame([], t.schema).columns
            new = upserts[table].select(*columns).dropDuplicates([*t.keys]) if table in upserts else self.spark.createDataFrame([], t.schema)
            gone = [new.select(*t.keys), *([deletes[table].select(*t.keys)] if table in deletes else [])]
            gone = reduce(DataFrame.unionByName, gone)
            touched = sorted(r[0] for r in gone.select(bucket.alias("b")).distinct().collect())  # as many as there are buckets at most
            if not touched:
                continue
            folders = pointer.get(table, {})
            old = self._rows(table, [folders[str(b)] for b in touched if str(b) in folders])
            other = gone.select(*[F.col(k).alias(f"__{k}") for k in t.keys])
            same = reduce(lambda x, y: x & y, [old[k].eqNullSafe(other[f"__{k}"]) for k in t.keys])
            merged = old.join(other, same, "left_anti").unionByName(new).withColumn(BUCKET, self._bucket(table))
            name = f"{table}/v{version}"
            merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{name}")
            held = {str(r[0]) for r in self.spark.read.parquet(f"{self.path}/{name}").select(BUCKET).distinct().collect()} if not merged.isEmpty() else set()
            pointer[table] = {b: f for b, f in folders.items() if int(b) not in touched} | {b: f"{name}/{BUCKET}={b}" for b in held}
        self._publish(version, pointer)

    def keep(self, n: int = 2) -> int:
        """Forgets all but the newest n versions and the folders only they name; returns how many versions went."""
        known = self.versions()
        old, live = known[:-n], {f for v in known[-n:] for t in self.pointer(v).values() for f in t.values()}
        for v in old:
            for folders in self.pointer(v).values():
                for f in {*folders.values()} - live:
                    self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}"), True)
            self._fs.delete(self._path(f"{v}.json"), False)
        return len(old)
