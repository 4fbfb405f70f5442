"""Quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a fixed vector of surface features. From labelled rows, each document of label 1
and each of label 0 form a preference pair; the weights minimise the logistic loss of all pairs'
feature differences, so a document's strength is the inner product of weights and features. The cut
is the exact quantile of the strengths of the training rows, at their share of label 0; scores are
logistic in strength and shifted so that the cut lies at ``THRESHOLD``.

The fit uses every labelled document that isn't held out, one row of each: of rows that repeat a
doc_id the one with the least features. A pair's loss depends on the difference of two strengths
only. So documents are summed by bin of strength, with moments up to the third, and the pairs' sums
follow from the pairs of bins by Taylor's series; its error, about 1e-9 of a term, is far below the
solver's other errors. Each Newton step is two passes of Spark over the labelled features. Up to
``max_labels`` documents are fitted by the driver alone, with the same sums; beyond that, its weights
for so many are only where the steps begin.

doc_id, labels, lang and source are no features.

Defined results: null text equals the empty text, which has the all-zero vector and a score like
others; labels that are null or whose doc_id is null are not learnt from; of contradicting labels of
a document the larger counts; without two classes among the training rows every score is 0.5; rows
that repeat a doc_id are scored each by its own text; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxspark.llm.common import documents, fresh, joinable, materialize, slices

THRESHOLD = 0.3
FOLDS = 5
#: Bins of strength have this width; so many pairs of bins are held at a time.
WIDTH = 1 / 32
PAIRS = 60_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NAMES = ("log_chars", "upper", "digit", "punct", "symbol", "bang", "pipe", "space", "newline", "distinct", "repeat", "lines", "word_length", "short", "odd_end", "caps_word", "top_word")

_CLASS = np.zeros((8, 256))
for _i, _chars in enumerate((range(65, 91), range(48, 58), b".,;:'\"()-", b"#$%&*@^~=+<>{}[]\\_/", b"!?", b"|", b" ", b"\n")):
    _CLASS[_i, [*_chars]] = 1
_PLAIN_END = re.compile(rb"[A-Za-z0-9\x80-\xff][.,;:]?$")


def features(text: str) -> list[float]:
    """Surface features of one whole text; shares enter as square roots, so small ones show."""
    data = text.encode("utf-8", "surrogatepass")
    words = WORD.findall(data)
    if not words:
        return [0.0] * len(NAMES)
    counts = _CLASS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.sqrt(counts / len(data)).tolist()
    n, lines = len(words), data.split(b"\n")
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd = sum(c for w, c in tally.items() if not _PLAIN_END.search(w))
    caps = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(len(data)), *shares, len(tally) / n, math.sqrt(again / n), len(set(lines)) / len(lines),
        math.log(sum(map(len, words)) / n), sum(c for w, c in tally.items() if len(w) < 4) / n, math.sqrt(odd / n), math.sqrt(caps / n), math.sqrt(max(tally.values()) / n),
    ]


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def strength_bins(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (2 * bin of strength + label) and for each the count, the moments of first to third order about the bin's centre, and the sums of z."""
    s = z @ w
    at = np.rint(s / WIDTH)
    off = s - at * WIDTH
    keys, place = np.unique(at.astype(np.int64) * 2 + y, return_inverse=True)
    rows = np.column_stack([np.ones(len(s)), off, off**2 / 2, off**3 / 6, z])
    order = np.argsort(place, kind="stable")
    return keys, np.add.reduceat(rows[order], np.flatnonzero(np.diff(place[order], prepend=-1)), axis=0) if len(s) else rows


class Kernel:
    """What the pairs of all bins add up to: at each bin's centre a label's chance to be ranked wrongly, summed over the
    other label's documents, with its first three derivatives; the curvature there; and the Hessian's part across labels."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray):
        order = np.argsort(keys)
        keys, sums = keys[order], sums[order]
        self.centres = [(keys[keys % 2 == y] // 2) * WIDTH for y in (0, 1)]
        (bad, good), width = (sums[keys % 2 == y] for y in (0, 1)), sums.shape[1] - 4
        self.slopes, self.curves, self.across = [np.zeros((len(c), 4)) for c in self.centres], [np.zeros(len(c)) for c in self.centres], np.zeros((width, width))
        step = max(1, PAIRS // len(bad))
        for at in range(0, len(good), step):
            some = slice(at, at + step)
            p = 1 / (1 + np.exp(np.clip(self.centres[1][some, None] - self.centres[0], -700, 700)))
            k = p * (1 - p)
            derived = (p, -k, k * (1 - 2 * p), -k * (1 - 6 * p + 6 * p * p))
            for n in range(4):
                for m in range(4 - n):
                    self.slopes[1][some, n] += derived[n + m] @ ((-1) ** m * bad[:, m])
                    self.slopes[0][:, n] += (-1) ** n * (good[some, m] @ derived[n + m])
            self.curves[1][some] = k @ bad[:, 0]
            self.curves[0] += good[some, 0] @ k
            self.across += good[some, 4:].T @ k @ bad[:, 4:]

    def sums(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents' part of the pairs' slope and curvature."""
        slope, curve, s = np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2), z @ w
        for label in (0, 1):
            mine, c = z[y == label], self.centres[label]
            own = s[y == label]
            right = np.clip(np.searchsorted(c, own), 1 if len(c) > 1 else 0, len(c) - 1)
            at = np.where((right > 0) & (own - c[right - 1] < c[right] - own), right - 1, right)
            off = own - c[at]
            a = self.slopes[label][at]
            slope += (2 * label - 1) * ((a[:, 0] + off * (a[:, 1] + off * (a[:, 2] / 2 + off * a[:, 3] / 6))) @ mine)
            curve += (mine * self.curves[label][at][:, None]).T @ mine
        return slope, curve


def newton(w: np.ndarray, pairs: float, bins: Callable, sums: Callable, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """The weights that minimise the logistic loss of all pairs. bins(w): strength_bins of all documents; sums(w, kernel): Kernel.sums of them."""
    for _ in range(steps):
        kernel = Kernel(*bins(w))
        slope, curve = sums(w, kernel)
        hessian = (curve - kernel.across - kernel.across.T) / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, ridge * w - slope / pairs)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of standardised features by Newton steps on the logistic loss of all pairs; mean and scale."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w = newton(np.zeros(x.shape[1]), float((y == 1).sum()) * float((y == 0).sum()), lambda w: strength_bins(z, y, w), lambda w, kernel: kernel.sums(z, y, w))
    return w, mean, scale


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label) of all labelled documents that aren't held out."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return materialize(known, "labels")


def _arrays(b: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES))
    return (x - mean) / scale, b.column("label").to_numpy()


def fit_table(one: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, pairs: float) -> np.ndarray:
    """newton() over a table (features, label): the rows stay in Spark, a step's bins and sums reach the driver."""
    width = len(NAMES)

    def bins(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, sums = strength_bins(*_arrays(b, mean, scale), w)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, np.ascontiguousarray(sums.T))], ["key", *names])

        names = [f"s{i}" for i in range(width + 4)]
        found = one.mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in names)).groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        return found["key"].to_numpy(), np.column_stack([found[c].to_numpy() for c in names])

    def sums(w: np.ndarray, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + width * width)
            for b in batches:
                slope, curve = kernel.sums(*_arrays(b, mean, scale), w)
                total += np.concatenate([slope, curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "total"])

        found = one.mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").toArrow()["total"].to_numpy()
        return found[:width], found[width:].reshape(width, width)

    return newton(w, pairs, bins, sums)


def smallest(values: DataFrame, rank: int) -> float:
    """The value at a rank from 0 of a table of one column v, by narrowing the range to the bin that holds it."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        span = F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / 1024))
        found = inside.groupBy(span.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(found.collect(), key=lambda r: r["low"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        if rank in (0, r["n"] - 1):
            return r["low"] if rank == 0 else r["high"]
        low, high = r["low"], r["high"]
    return low


def fit_score(table: DataFrame, known: DataFrame, most: int, name: str = "features") -> Column | None:
    """Score as a column of the features called `name`, fitted to all known documents of table (doc_id, features); None without two classes.

    Up to `most` documents are fitted by the driver alone. If there are more, its weights are where the
    steps over all of them begin; the minimum is one, so it doesn't depend on that.
    """
    one = materialize(table.join(joinable(known), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("label").alias("label")), "labelled")
    n, n_good = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    n_bad = n - n_good
    if not n_good or not n_bad:
        return None
    # by hash first, as every partition sends its first rows to the driver before the limit holds
    some = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = (some if n > most else one).toPandas().sort_values("doc_id")
    x, y = np.array(sample["features"].tolist(), dtype=float).reshape(len(sample), len(NAMES)), sample["label"].to_numpy()
    w, mean, scale = fit_pairs(x, y) if len(set(y)) > 1 else (np.zeros(len(NAMES)), np.zeros(len(NAMES)), np.ones(len(NAMES)))
    if n <= most:
        strengths = np.sort(((x - mean) / scale) @ w)
        cut = (strengths[n_bad - 1] + strengths[min(n_bad, n - 1)]) / 2
    else:
        each = one.agg(*(f(F.get("features", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(len(NAMES)))).first()
        begun, mean, scale = w / scale, np.array(each[: len(NAMES)]), np.array(each[len(NAMES) :])
        scale[scale < 1e-9] = 1.0
        w = fit_table(one, begun * scale, mean, scale, float(n_good) * float(n_bad))
        strengths = materialize(one.select(_strength("features", w / scale, -float((mean / scale) @ w)).alias("v")), "strengths")
        cut = (smallest(strengths, n_bad - 1) + smallest(strengths, min(n_bad, n - 1))) / 2
    strength = _strength(name, w / scale, float(-(mean / scale) @ w - cut + math.log(THRESHOLD / (1 - THRESHOLD))))
    return 1 / (1 + F.exp(-F.least(F.greatest(strength, F.lit(-700.0)), F.lit(700.0))))


def _strength(name: str, weight: np.ndarray, offset: float) -> Column:
    return F.aggregate(F.zip_with(name, F.array(*[F.lit(float(v)) for v in weight]), lambda a, b: a * b), F.lit(offset), lambda s, v: s + v)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    table = materialize(documents(docs, id_col, text_col).mapInArrow(_feature_batches, "doc_id long, features array<double>"), "features")
    score = fit_score(table, known_labels(labels, id_col, label_col), max_labels)
    scored = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "features")
    if score is None:
        return scored.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _rows_with_features(text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [features(t or "") for t in b.column(b.schema.names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], [*b.schema.names, name])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, but those whose own text is predicted 0.

    The rows are written with their features, so each is judged where it lies, and null and repeated
    doc_ids need no join; only doc_ids and features meet the labels for the fit.
    """
    name = fresh(docs, "features")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    rows = materialize(docs.mapInArrow(_rows_with_features(text_col, name), schema), "rows")
    score = fit_score(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[name].alias("features")), known_labels(labels, id_col, label_col), max_labels, name)
    return docs if score is None else rows.where(score >= THRESHOLD).drop(name)
