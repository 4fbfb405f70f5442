"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into words of letters; the word-internal n-grams of 2 to 4 characters, word
ends counting as one, are hashed into BUCKETS. A text's vector is the mean of its subwords' embeddings, and
a linear layer over it gives the languages' scores. Both are learned by stochastic gradient descent in
numpy, over random draws of each text's subwords, so that short texts are met as well. As the layer is
linear, scoring a text is a mean over its subwords of rows of one small table, embeddings times weights.

The fit takes a bounded sample: `sample` texts, spread evenly over the languages (at most MAX_LANGS, the
most frequent) by a hash of language and text, copies counting once, and DRAWN subwords of each, drawn
from the whole text. A fifth of the sample is kept for calibration: the temperature of the softmax with
the least loss there, and the smallest score from which on a share `accepted` of the answers is right, both
over whole draws and short ones;
answers below it are marked as rejected. All texts are scored whole.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; without any
labelled text all are; languages are taken as they stand, case included; rows that repeat a doc_id are
scored each, those with a null doc_id are not held out; other columns, whatever their names, stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
DIM = 16
SIZES = (2, 3, 4)
SAMPLE = 4_000
DRAWN = 1_024
MAX_LANGS = 200
CHUNK = 1 << 20
#: Subwords in the short draws that calibration looks at, beside the whole ones.
SHORT = (6, 24)
UNDETERMINED = "und"


@cache
def letter_table() -> np.ndarray:
    """Whether each character of the first plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points, one 0 for whatever stands between words, at both ends too."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        is_letter[at] = chr(codes[at]).isalpha()
    spaced = np.concatenate([[0], np.where(is_letter, codes, 0), [0]]).astype(np.uint64)
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 0) | (spaced[:-1] != 0)
    return spaced[keep]


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text; none if it has no letter."""
    chars = letters(text)
    if len(chars) < 3:
        return np.empty(0, np.uint16)
    out = []
    for size in SIZES:
        n = len(chars) - size + 1
        if n <= 0:
            continue
        mixed, inside = np.full(n, size, np.uint64), np.ones(n, bool)
        for k in range(size):
            mixed = (mixed + chars[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            if 0 < k < size - 1:
                inside &= chars[k : k + n] != 0
        out.append((mixed[inside] >> np.uint64(7)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.uint16)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK characters, cut at spaces where there are any, so that memory stays bounded."""
    at = 0
    while len(text) - at > CHUNK:
        space = text.find(" ", at + CHUNK, at + 2 * CHUNK)
        end = space if space > 0 else at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:] if at else text


@dataclass
class Model:
    """Languages and what each subword adds to their scores."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def scores(self, text: str) -> np.ndarray | None:
        """Calibrated probabilities of the languages; None for a text without letters."""
        total, n = np.zeros(len(self.langs)), 0
        for piece in pieces(text):
            found = subwords(piece)
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return softmax((total / n + self.bias) / self.temperature) if n else None


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def drawn(text: str, seed: int) -> np.ndarray:
    """At most DRAWN subwords, from all over the text."""
    rng, held, seen = np.random.default_rng(abs(seed)), np.empty(0, np.uint16), 0
    for piece in pieces(text):
        found = subwords(piece)
        seen += len(found)
        if len(held) + len(found) <= DRAWN and seen <= DRAWN:
            held = np.concatenate([held, found])
            continue
        # of all seen so far, each is as likely to be held
        take = int(rng.binomial(DRAWN, len(found) / seen))
        take = max(min(take, len(found)), DRAWN - len(held))
        held = np.concatenate([rng.permutation(held)[: DRAWN - take], rng.choice(found, take, replace=False)])
    return held


def train(texts: list[np.ndarray], classes: np.ndarray, n_classes: int, epochs: int = 12, batch: int = 32, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, n_classes)), np.zeros(n_classes)
    steps, done = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            size = int(rng.choice((16, 48, 128)))
            picked = np.stack([texts[r][rng.integers(0, len(texts[r]), size)] for r in rows])
            mean = embeddings[picked].mean(axis=1)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(rows)), classes[rows]] -= 1
            step = rate * (1 - done / steps) / len(rows)
            back = error @ weights.T
            weights -= step * mean.T @ error
            bias -= step * error.sum(axis=0)
            # each example moves its own subwords, as one by one
            np.add.at(embeddings, picked.ravel(), np.repeat(-step * len(rows) / size * back, size, axis=0))
            done += 1
    return embeddings, weights, bias


def calibrated(model: Model, texts: list[np.ndarray], classes: np.ndarray, accepted: float) -> Model:
    """Temperature of the least loss, and the score from which on a share of the answers is right."""
    if not texts:
        return model
    rng = np.random.default_rng(len(texts))
    short = [t[rng.integers(0, len(t), n)] for n in SHORT for t in texts]
    texts, classes = [*texts, *short], np.tile(classes, 1 + len(SHORT))
    logits = np.stack([model.table[t].mean(axis=0, dtype=np.float64) for t in texts]) + model.bias
    temperatures = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(classes)), classes], 1e-12)).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == classes[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= accepted)
    model.least = float(p.max(axis=1)[order[enough[-1]]]) if len(enough) else 1.0
    return model


def held_out(id_: Column) -> Column:
    """Whether a document is kept from the fit: CRC-32 of its id modulo 4 is 2."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


SAMPLED = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("subwords", pa.binary())])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, hashes, texts = (b.column(c).to_pylist() for c in ("lang", "h", "text"))
        found = [drawn(t, h).tobytes() for t, h in zip(texts, hashes, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], schema=SAMPLED)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, accepted: float = 0.99) -> Model | None:
    """A model of the labelled texts of the rows that `learn` marks; None if there are none with letters."""
    text, lang = docs[text_col].cast("string"), docs[lang_col].cast("string")
    known = docs.where(learn & lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return None
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / len(counts) / max(1, r["n"])))])
    chance = F.shiftrightunsigned("h", 11) / float(1 << 53)
    rows = known.where(chance < rates[F.col("lang")]).dropDuplicates(["h"]).mapInArrow(_draw, "lang string, h long, subwords binary")
    rows = [r for r in rows.orderBy("h").limit(2 * sample).collect() if r["subwords"]]  # at most sample * 2 * DRAWN * 2 bytes
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    texts, classes = [np.frombuffer(r["subwords"], np.uint16) for r in rows], np.array([langs.index(r["lang"]) for r in rows])
    kept = np.array([(r["h"] >> 3) % 5 == 0 for r in rows]) if len(rows) >= 50 else np.zeros(len(rows), bool)
    embeddings, weights, bias = train([t for t, k in zip(texts, kept, strict=True) if not k], classes[~kept], len(langs))
    model = Model(langs, (embeddings @ weights).astype(np.float32), bias)
    return calibrated(model, [t for t, k in zip(texts, kept, strict=True) if k], classes[kept], accepted)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGS floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [None if m is None or t is None else m.scores(t) for t in b.column("text").to_pylist()]
            best = [None if p is None else int(p.argmax()) for p in found]
            scores = [0.0 if p is None else float(p[k]) for p, k in zip(found, best, strict=True)]
            columns = [b.column("doc_id"), pa.array([UNDETERMINED if k is None else m.langs[k] for k in best], pa.string()), pa.array(scores, pa.float64())]
            columns.append(pa.array([k is None or s < m.least for k, s in zip(best, scores, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row, learned from the rows not held out."""
    model = fit(docs, ~held_out(docs[id_col]), text_col, lang_col, sample)
    out = identify(docs, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
