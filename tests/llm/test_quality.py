"""The quality classifier: fit, cut and folds by hand, hot ids, clashing columns, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.llm import quality as Q

SF = "/root/testdata/sf0.001"


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def strengths_by_descent(x, y, seed=7):
    """The same pairs, by plain gradient descent on the same loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y == 1), Q.PAIRS)] - z[rng.choice(np.flatnonzero(y == 0), Q.PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(30_000):
        g = 1e-3 * w - d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / len(d)
        w -= 0.5 * g
        if np.abs(g).max() < 1e-7:
            break
    return z @ w, w


def test_fit_cut_and_folds(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert set(got) == set(text) and all(got[i].held_out == is_held(i) for i in got)
    learnt = sorted(i for i in label if i in text and not is_held(i) and label[i] in (0, 1))
    x, y = np.array([Q.features(text[i]) for i in learnt]), np.array([label[i] for i in learnt])
    w, mean, scale = Q.fit_pairs(x, y)
    z, by_hand = (x - mean) / scale, strengths_by_descent(x, y)[1]
    gradient = lambda v: np.abs(v - w).max()
    assert gradient(by_hand) < 0.05 * max(1.0, np.abs(w).max())
    s = np.sort(z @ w)
    at = int(round((y == 0).mean() * len(y)))
    cut = (s[at - 1] + s[min(at, len(y) - 1)]) / 2
    for i in text:
        strength = ((np.array(Q.features(text[i])) - mean) / scale) @ w
        score = 1 / (1 + np.exp(-(strength - cut + np.log(0.3 / 0.7))))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)


def test_a_hot_labelled_id_gives_one_row(spark, monkeypatch):
    good, bad = "A plain sentence of ordinary words, and another one after it. ", "BUY!! NOW!! ### $$$ !!! ||| "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(300)] + [(7, bad * 3)] * 2_000 + [(None, None), (None, good)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = Q.fit_pairs
    monkeypatch.setattr(Q, "fit_pairs", lambda x, y: seen.append(len(x)) or plain(x, y))
    got = Q.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and seen == [sum(not is_held(i) for i in range(300))]
    Q.score_documents(docs, labels, max_labels=50).collect()
    assert seen[1] <= 50


def test_clashing_columns_and_small_tables(spark):
    good, bad = "A plain sentence of ordinary words, and another one after it. ", "BUY!! NOW!! ### $$$ !!! ||| "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5), "f", 1, "d") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features string, label int, held_out string")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(100)], "doc_id long, quality int, label int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(100) if i % 2}
    assert {r.predicted for r in Q.score_documents(docs, labels).where(F.col("doc_id") % 2 == 1).collect()} == {1}
    assert Q.score_documents(docs.limit(0), labels).collect() == [] and Q.keep_good(docs.limit(0), labels).collect() == []
    assert Q.keep_good(docs, labels.limit(0)).count() == 100


def loss_slope(z, y, w):
    """Of the logistic loss of all pairs, pair by pair."""
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    return 1e-3 * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d)


def test_all_pairs_count():
    rng = np.random.default_rng(3)
    y = (rng.random(700) < 0.8).astype(int)
    x = rng.normal(size=(700, 5)) * [1, 2, 3, 1, 1] + y[:, None] * [1, 0.5, 3, 0, 0]
    x[0] *= 1e4
    w, mean, scale = Q.fit_pairs(x, y)
    assert np.abs(loss_slope((x - mean) / scale, y, w)).max() < 1e-9


def test_every_labelled_document_is_learnt_from(spark):
    """With few documents on the driver the fit and the cut are those of all, not of a sample."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    text, label = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    learnt = sorted(i for i in label if i in text and not is_held(i) and label[i] in (0, 1))
    x, y = np.array([Q.features(text[i]) for i in learnt]), np.array([label[i] for i in learnt])
    w, mean, scale = Q.fit_pairs(x, y)
    s = np.sort(((x - mean) / scale) @ w)
    cut = (s[(y == 0).sum() - 1] + s[(y == 0).sum()]) / 2
    strength = {i: ((np.array(Q.features(t)) - mean) / scale) @ w - cut for i, t in text.items()}
    assert len(learnt) > 200
    for most in (60, 1):
        got = Q.score_documents(docs, labels, max_labels=most).collect()
        assert all(r.score == pytest.approx(1 / (1 + np.exp(-(strength[r.doc_id] + np.log(0.3 / 0.7)))), abs=1e-7) for r in got) and len(got) == len(text)
    kept = {r.doc_id for r in Q.keep_good(docs, labels, max_labels=60).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_ranks(spark):
    values = [0.5] * 40 + [-3.0, 1e9, 0.25, 0.25, *(i / 7 for i in range(3_000))]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    assert [Q.smallest(table, k) for k in (0, 1, 30, 45, 1_500, len(values) - 1)] == [sorted(values)[k] for k in (0, 1, 30, 45, 1_500, len(values) - 1)]
