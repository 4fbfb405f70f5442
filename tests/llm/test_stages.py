"""Empty tables through every operator and stage; the near-duplicate stage against brute force; clashing columns."""

import re

import pytest

import corpus_pipeline
from voxspark.llm import bpe, exact_dedup, jaccard, pieces, quality, secret_scan, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "op1": lambda d: secret_scan.secret_spans(d),
    "op2": lambda d: token_counts.token_counts(d, pieces.tokenizer_path("piece_bpe_32k.model")),
    "op3": lambda d: suffix_dedup.repeated_bytes(d),
    "op5": lambda d: quality.score_documents(d, d.sparkSession.read.parquet(f"{SF}/labels.parquet")),
    "op6": lambda d: exact_dedup.exact_duplicates(d),
    "op7": lambda d: bpe.encode_decode(d, pieces.tokenizer_path("word_bpe_49k.json")),
    "op8": lambda d: jaccard.jaccard_components(d, words=3, percent=90),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_stages(spark, name):
    none = spark.createDataFrame([], DOCS)
    out = dict(corpus_pipeline.STAGES)[name](spark, none, SF)
    assert out.collect() == [] and (name == "packing" or out.columns == none.columns)


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, text in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                group[max(top(a), top(b))] = min(top(a), top(b))
    want = {i for i in ids if top(i) == i}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == want and len(want) < len(ids)


def test_stages_keep_clashing_columns(spark):
    names = ["features", "row_key", "row_hash", "row_group", "row_id", "kept", "component_id", "label"]
    good = "A plain sentence of ordinary words, and another one after it number {}. "
    rows = [(i, good.format(i) * (1 + i % 4), "en", "s", 1, *names) for i in range(12)] + [(20, good.format(3) * 4, "en", "s", 1, *names), (None, None, None, None, None, *names)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
