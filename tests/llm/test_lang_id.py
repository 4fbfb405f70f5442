"""Language identification: held-out accuracy, scores by hand, odd rows."""

import zlib

import numpy as np
import pytest

from voxspark.llm import lang_id as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double, h long, n long"


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs, ~L.held_out(docs["doc_id"]))


def test_whole_table(docs, model):
    truth = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    got = {r.doc_id: r for r in L.predict_languages(docs).collect()}
    assert set(got) == set(truth) and all(got[i].held_out == is_held(i) for i in got)
    unseen = [i for i in got if is_held(i) and any(c.isalpha() for c in truth[i][1] or "")]
    assert np.mean([got[i].lang_pred == truth[i][0] for i in unseen]) > 0.98
    sure = [i for i in got if not got[i].rejected]
    assert len(sure) > 0.95 * len(got) and np.mean([got[i].lang_pred == truth[i][0] for i in sure]) > 0.99
    for i in list(got)[::50]:  # the same model gives the same rows
        p = model.scores(truth[i][1])
        assert got[i].score == pytest.approx(p.max()) and got[i].lang_pred == model.langs[int(p.argmax())]


def test_subwords_by_hand():
    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        line = [0, *[x for w in words for x in (*map(ord, w), 0)]]
        out = []
        for size in L.SIZES:
            for i in range(len(line) - size + 1):
                part = line[i : i + size]
                if any(c == 0 for c in part[1:-1]):
                    continue
                mixed = size
                for c in part:
                    mixed = (mixed + c) * 0x9E3779B97F4A7C15 % 2**64
                    mixed ^= mixed >> 29
                out.append((mixed >> 7) % L.BUCKETS)
        return out

    for text in ("Hello, World!", "a", "É 日本語 x1y2", "  --  ", "", "𝔘ber straße\n\nİ"):
        assert L.subwords(text).tolist() == (plain(text) if any(c.isalpha() for c in text) else [])


def test_pieces_cover_the_text(model, monkeypatch):
    text = "der Hund und die Katze " * 3_000
    whole = model.scores(text)
    monkeypatch.setattr(L, "CHUNK", 1_000)
    assert "".join(L.pieces(text)) == text and np.allclose(model.scores(text), whole, atol=1e-3)
    assert "".join(L.pieces("x" * 5_500)) == "x" * 5_500
    assert len(L.drawn(text, 5)) == L.DRAWN and len(L.drawn("ab", 5)) == len(L.subwords("ab"))


def test_odd_rows(spark):
    en, de = "the cat and the dog of this house ", "der hund und die katze von haus "
    rows = [(i, (en if i % 2 else de) * (1 + i % 7), "en" if i % 2 else "de") for i in range(200)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !?", "en"), (None, en, None), (None, de, "de"), (2**60 + 1, en, None), (2**60 + 1, de, None), (503, de * 20_000, None)]
    rows += [(600, en, "en")] * 300  # copies of one text under a hot id
    df = spark.createDataFrame([(*r, "x", 1.0, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = L.predict_languages(df).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((i, "und" if t is None or not any(c.isalpha() for c in t) else "de" if t.startswith("der") else "en") for i, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=key) == want
    assert all(0 <= r.score <= 1 and r.held_out == is_held(r.doc_id) for r in got)
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")


def test_nothing_to_learn(spark):
    assert L.predict_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None, "", 0.0, 0, 0), (2, "!", "en", "", 0.0, 0, 0)], SCHEMA)
    assert {(r.lang_pred, r.score, r.rejected) for r in L.predict_languages(unlabelled).collect()} == {("und", 0.0, True)}
