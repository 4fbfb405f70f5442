"""The stages of the pipeline, each on its own input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from voxspark.llm import jaccard, packing, quality, secret_scan
from voxspark.llm.pieces import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept, given = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in before.collect()}
        assert set(kept) <= set(given)
        if name == "exact_dedup":
            last = {}
            for i, t in given.items():
                last[t] = max(i, last.get(t, i))
            assert set(kept) == set(last.values())
        if name == "near_dedup":
            assert 0 < len(kept) < len(given)
        if name == "secrets":
            assert set(kept) == set(given) and not any(secret_scan.scan(t) for t in kept.values())
            assert all(kept[i] == t for i, t in given.items() if not secret_scan.scan(t))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len(kept)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_judges_each_row(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in quality.score_documents(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    bad, good = next(text[i] for i, p in scored.items() if not p), next(text[i] for i, p in scored.items() if p)
    more = [(None, bad), (None, good), (None, good), (10**9, bad), (10**9, good)]
    got = rows_of(quality.keep_good(docs.unionByName(spark.createDataFrame(more, docs.schema)), labels))
    want = [(i, t) for i, t in text.items() if scored[i]] + [(None, good), (None, good), (10**9, good)]
    assert got == sorted(want, key=str)


def test_near_judges_each_row(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (2, one + " end"), (2, two), (5, two + " end"), (7, two + " stop"), (9, "alone"), (None, one + " end"), (None, one + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 2 loses its copy of 1 and keeps the other text
    want = [(1, one), (2, two), (9, "alone"), (None, one + " end"), (None, one + " end")]
    assert rows_of(corpus_pipeline.near(spark, docs, SF)) == sorted(want, key=str)


BYTE_BPE = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize(
    "run",
    [quality._feature_batches, quality._rows_with_features("text", "features"), jaccard._set_rows(5), secret_scan._masked(["doc_id", "text"], 1), secret_scan._scan_batches, packing._cut(BYTE_BPE, 1024)],
)
def test_a_large_batch_is_worked_off_in_parts(run):
    """What a worker holds beside Spark's batch doesn't grow with it: the executor's memory has to last for all stages."""
    words, rng = np.array([f"word{i}" for i in range(500)]), np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 250)) for _ in range(4_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    packing.encode_bytes("warm", BYTE_BPE)
    list(run(iter([batch.slice(0, 10)])))
    size, arrow, most = sum(map(len, texts)), pa.total_allocated_bytes(), 0
    del texts
    tracemalloc.start()
    for out in run(iter([batch])):
        most = max(most, pa.total_allocated_bytes() - arrow)
        assert out.num_rows < 3_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + most < size
