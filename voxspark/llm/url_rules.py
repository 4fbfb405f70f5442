"""URL rules as a sort-merge range join.

A host is turned into a key of its reversed labels, each ended by a dot (``a.example.net`` ->
``net.example.a.``), so a rule's host covers exactly the keys that start with its own key: an
interval. URLs and rules are sorted into ranges of (key, kind, row hash) by Spark's range
partitioning, so one host with very many pages spreads over several ranges. The rules open at the
start of a range are those whose key is a prefix of the range's first key; a range's few prefixes
find them in an equality join. Each range is swept once with a stack of the active, nested rules.

Defined results: a null url, or one without ``://``, has an empty host and path and matches no rule;
repeated rows give repeated results; of matching rules the one with the longest host + path wins,
then the longest host, then the smaller text, then block; null rule parts count as empty, a rule
with an empty host matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import materialize, partitions


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def host_key(host: Column) -> Column:
    """Reversed labels with a closing dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, kind); kind 0 opens a rule, kind 1 is a url. Ids never leave Arrow."""
    bucket, stack = None, []
    for batch in batches:
        rules, verdicts = [], []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "kind", "key", "path", "rule", "verdict"))
        for b, kind, key, path, rule, verdict in zip(*columns, strict=True):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, path, rule, verdict))
                continue
            fits = [(-len(r), -len(k), r, v != "block", v) for k, p, r, v in stack if path.startswith(p)]
            best = min(fits, default=None)
            rules.append(best and best[2])
            verdicts.append(best and best[4])
        urls = batch.filter(pc.equal(batch.column("kind"), 1))
        found = [urls.column("page_id"), urls.column("host"), urls.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
        yield pa.RecordBatch.from_arrays(found, ["page_id", "host", "path", "rule", "verdict"])


def prefixes(key: Column) -> Column:
    """All keys that cover a key: its first label, its first two, up to itself."""
    parts = F.split(key, r"\.")  # the last, after the closing dot, is empty
    upto = lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "."), F.lit("."))
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), upto)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page. rules: host, path, verdict."""
    n = partitions(pages.sparkSession)
    host, path = split_url(pages[url_col].cast("string"))
    urls = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    id_type, none = urls.schema["page_id"].dataType, F.lit(None).cast("string")
    rows = urls.select(
        F.lit(1).alias("kind"), host_key(F.col("host")).alias("key"), F.xxhash64("page_id", "host", "path").alias("tie"),
        "page_id", "host", "path", none.alias("rule"), none.alias("verdict"),
    )
    part = lambda c: F.coalesce(rules[c].cast("string"), F.lit(""))
    parts = rules.select(part("host").alias("host"), part("path").alias("path"), part("verdict").alias("verdict"))
    opened = parts.where("host <> ''").distinct().select(
        F.lit(0).alias("kind"), host_key(F.col("host")).alias("key"), F.xxhash64("host", "path", "verdict").alias("tie"),
        F.lit(None).cast(id_type).alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict",
    )
    dealt = opened.unionByName(rows).repartitionByRange(n, "key", "kind", "tie").withColumn("bucket", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    begun = dealt.groupBy("bucket").agg(F.min("key").alias("first")).where("first <> ''")
    begun = begun.select("bucket", F.explode(prefixes(F.col("first"))).alias("key"))
    carried = opened.join(begun, "key").select(dealt.columns)
    swept = dealt.unionByName(carried).repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int"))
    ordered = swept.sortWithinPartitions("bucket", "key", "kind").drop("tie")
    found = ordered.mapInArrow(sweep, f"page_id {id_type.simpleString()}, host string, path string, rule string, verdict string")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
