"""A training corpus from raw documents: quality, exact copies, near copies, secrets, packing.

Every stage takes all that its predecessor kept. Stages 1 to 4 return the columns of documents.
Null texts count as empty; rows with a null doc_id are scored like others, are never taken for near
copies, have their secrets masked (a null text stays null) and are packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.llm.common import fresh, joinable, materialize, read_table, text_of
from voxspark.llm.exact_dedup import exact_duplicates
from voxspark.llm.jaccard import jaccard_components
from voxspark.llm.packing import pack
from voxspark.llm.pieces import tokenizer_path
from voxspark.llm.quality import keep_good
from voxspark.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def _row_key(docs: DataFrame) -> Column:
    """What tells rows apart, also those that repeat a doc_id: the id and a digest of the text."""
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(F.encode(text_of(docs), "UTF-8"), 256)).alias("sha"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of its repeated rows one.

    The dropped rows are joined, fewer than the kept ones, and only documents that repeat an id are
    grouped by it.
    """
    judged, key = materialize(exact_duplicates(docs), "judged"), fresh(docs, "row_key")
    named = judged.select(F.struct(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).alias(key), "kept")
    gone = joinable(named.where("NOT kept").select(key).distinct())
    repeats = named.where("kept").groupBy(key).count().where("count > 1").select(key)
    rows = docs.withColumn(key, _row_key(docs))
    same = lambda other: rows[key].eqNullSafe(other[key])
    left = rows.join(gone, same(gone), "left_anti")
    if repeats.isEmpty():
        return left.drop(key)
    repeats = joinable(repeats)
    one = left.join(repeats, same(repeats), "left_semi").dropDuplicates([key])
    return left.join(repeats, same(repeats), "left_anti").unionByName(one).drop(key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the smallest doc_id, of each group linked by five-word shingles at 0.8 or more stays.

    Rows are told apart by a 64-bit hash of doc_id and text, so texts under a repeated doc_id are judged
    each on its own; rows with a null doc_id have none and stay.
    """
    row, group, number = fresh(docs, "row_hash"), fresh(docs, "row_group"), fresh(docs, "row_id")
    rows = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64(_row_key(docs))))
    linked = jaccard_components(rows, words=5, percent=80, id_col=row).where("doc_id <> component_id")
    linked = materialize(linked.select(F.col("doc_id").alias(row), F.col("component_id").alias(group)).distinct(), "near")
    members = joinable(linked.unionByName(linked.select(F.col(group).alias(row), group).distinct()))
    named = rows.select(row, F.col("doc_id").cast("long").alias(number)).join(members, row).distinct()
    stays = named.groupBy(group).agg(F.min_by(row, F.struct(number, row)).alias(row))
    gone = materialize(named.select(row).distinct().join(stays.select(row), row, "left_anti"), "gone")
    return rows.join(joinable(gone), row, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows where the table has it."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 ids."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]

#: SQL can't run the classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
