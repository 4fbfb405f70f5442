"""Order-dependent assignment: one fold for each recording, in parallel over recordings."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.config import UNKNOWN_BASE, UNKNOWN_SPEAKER, Clustering, UnknownClustering
from voxspark.functions import vectors as V

ASSIGNED = "speaker_id int, similarity double, margin double, reason string"
CANDIDATES = "array<struct<idx:int,name:string,similarity:double>>"


def unit(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    n = np.linalg.norm(x)
    return x / n if n > 1e-10 else x


class Centroids:
    """Unit centroids with counts; enrolled ones never move."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.counts: list[int] = []
        self.frozen: list[bool] = []

    def add(self, x, frozen: bool = False, count: int = 1) -> int:
        self.rows.append(unit(x))
        self.counts.append(count)
        self.frozen.append(frozen)
        return len(self.rows) - 1

    def similarities(self, x: np.ndarray) -> np.ndarray:
        u, out = unit(x), np.zeros(len(self.rows))
        for i, c in enumerate(self.rows):
            length = np.linalg.norm(c) * np.linalg.norm(u)
            out[i] = c @ u / length if len(c) == len(u) and length > 0 else 0.0
        return out

    def blend(self, i: int, x, sign: int = 1) -> None:
        n = self.counts[i]
        if self.frozen[i] or (sign < 0 and n <= 1):
            return
        self.rows[i] = unit((self.rows[i] * n + sign * unit(x)) / (n + sign))
        self.counts[i] = n + sign

    def dump(self) -> str:
        return json.dumps([[c.tolist() for c in self.rows], self.counts, self.frozen])

    @classmethod
    def load(cls, text: str) -> Centroids:
        out = cls()
        for c, n, f in zip(*json.loads(text), strict=True):
            out.rows.append(np.array(c))
            out.counts.append(n)
            out.frozen.append(f)
        return out


def assign(state: Centroids, x, config: Clustering) -> tuple[int, float, float, str]:
    """One step of the online clusterer: (speaker, similarity, margin, reason)."""
    if x is None:
        return 0, 0.0, 0.0, "no_embedding"
    if not state.rows:
        return state.add(x), 1.0, 1.0, "new_speaker"
    s = state.similarities(x)
    best = int(s.argmax())
    # with one speaker the missing second is -1
    margin = float(s[best] - (np.delete(s, best).max() if len(s) > 1 else -1.0))
    if s[best] >= config.similarity:
        if len(s) > 1 and margin < config.margin:
            return UNKNOWN_SPEAKER, float(s[best]), margin, "ambiguous_match"
        state.blend(best, x)
        return best, float(s[best]), margin, "confident_match"
    if len(s) < config.num_speakers:
        return state.add(x), 1.0, 1.0, "new_speaker"
    reason = "below_minimum_threshold" if s[best] < config.minimum else "no_confident_match"
    return UNKNOWN_SPEAKER, float(s[best]), margin, reason


def _fold(df: DataFrame, keys: list[str], order: list[str], extra: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {extra}"
    return df.groupBy(*keys).applyInPandas(lambda pdf: step(pdf.sort_values(order, ignore_index=True)), schema)


def ranked(state: Centroids, names: list[str], x) -> list[tuple[int, str, float]]:
    """Every speaker with its cosine before x is assigned, best first."""
    found = [(i, names[i] if i < len(names) else f"Speaker {i + 1}", float(s)) for i, s in enumerate(state.similarities(x))]
    return sorted(found, key=lambda c: (-c[2], c[0]))


def assign_speakers(phrases: DataFrame, keys: list[str], order: list[str], config: Clustering = Clustering(), roster: list[tuple[str, list[float]]] | None = None, vector: str = "embedding", candidates: bool = False) -> DataFrame:
    """Online clustering of each recording's phrases in order. roster: enrolled speakers, which come first.

    With candidates, every speaker known at that step too; a new one with 1 as its own best match.
    """
    names, enrolled = [n for n, _ in roster or []], [c for _, c in roster or []]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        state, found, seen = Centroids(), [], []
        for c in enrolled:
            state.add(c, frozen=True)
        for x in pdf[vector]:
            if candidates:
                seen.append([] if x is None else ranked(state, names, x))
            found.append(assign(state, x, config))
            if candidates and found[-1][3] == "new_speaker":
                seen[-1] = [(found[-1][0], f"Speaker {found[-1][0] + 1}", 1.0), *seen[-1]]
        out = pdf.assign(**{n: [f[i] for f in found] for i, n in enumerate(("speaker_id", "similarity", "margin", "reason"))})
        return out.assign(candidates=[[{"idx": i, "name": n, "similarity": s} for i, n, s in row] for row in seen]) if candidates else out

    return _fold(phrases, keys, order, ASSIGNED + (f", candidates {CANDIDATES}" if candidates else ""), step)


def inherit_speaker(pdf: pd.DataFrame, vector: str = "embedding") -> pd.DataFrame:
    """Within a chunk, phrases without embedding take the last assigned speaker; leading ones 0."""
    own = pdf["speaker_id"].where(pdf[vector].notna())
    return pdf.assign(speaker_id=own.ffill().fillna(0).astype(int), reason=pdf["reason"].where(own.notna() | own.ffill().notna(), "inherited"))


def cluster_unknowns(segments: DataFrame, keys: list[str], order: list[str], config: UnknownClustering = UnknownClustering(), vector: str = "embedding") -> DataFrame:
    """Numbered unknown speakers for segments with speaker -1; at the limit the nearest cluster takes them."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        state, ids = Centroids(), []
        for speaker, x in zip(pdf["speaker_id"], pdf[vector], strict=True):
            if speaker != UNKNOWN_SPEAKER:
                ids.append(None)
                continue
            if x is None:
                ids.append(UNKNOWN_BASE)
                continue
            s = state.similarities(x)
            best = int(s.argmax()) if len(s) else -1
            if best < 0 or (s[best] < config.similarity and len(s) < config.max_unknown):
                best = state.add(x)
            else:
                state.blend(best, x)
            ids.append(UNKNOWN_BASE - best)
        return pdf.assign(unknown_id=pd.array(ids, dtype="Int64"))

    return _fold(segments, keys, order, "unknown_id int", step)


def whole(ids: list) -> pd.array:
    """Speaker ids; environmental rows have none."""
    return pd.array([None if n is None or pd.isna(n) else int(n) for n in ids], dtype="Int64")


def recluster_from(segments: DataFrame, keys: list[str], order: list[str], config: Clustering = Clustering(), from_index: str = "from_index", vector: str = "embedding") -> DataFrame:
    """Assigns segments from the segment_index `from_index` on again, against the state of the earlier ones; environmental rows keep theirs."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        state, new = Centroids(), []
        start = pdf[from_index].iloc[0]
        for i, x, env, old in zip(pdf["segment_index"], pdf[vector], pdf["is_environmental"], pdf["speaker_id"], strict=True):
            if x is None or env:
                new.append(old)
                continue
            found = assign(state, x, config)[0]
            new.append(old if i < start else found)
        return pdf.assign(new_speaker_id=whole(new))

    return _fold(segments, keys, order, "new_speaker_id int", step)


def reassign_segment(segments: DataFrame, corrections: DataFrame, keys: list[str], order: list[str], config: Clustering = Clustering(), vector: str = "embedding") -> DataFrame:
    """A correction (keys, segment_index, to_speaker) moves that segment's vector between centroids; later segments are assigned again."""
    fixed = corrections.select(*keys, F.col("segment_index").alias("__at"), F.col("to_speaker").alias("__to"))
    rows = segments.join(fixed, keys, "left")
    if "is_environmental" not in segments.columns:
        rows = rows.withColumn("is_environmental", F.lit(False))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        state, new, at = Centroids(), [], pdf["__at"].iloc[0]
        for i, x, env, old in zip(pdf["segment_index"], pdf[vector], pdf["is_environmental"], pdf["speaker_id"], strict=True):
            if x is None or env:
                new.append(old)
                continue
            found = assign(state, x, config)[0]
            if pd.isna(at) or i < at:
                new.append(old)
            elif i == at:
                to = int(pdf["__to"].iloc[0])
                if 0 <= old < len(state.rows) and old != to:
                    state.blend(int(old), x, -1)
                if 0 <= to < len(state.rows) and old != to:
                    state.blend(to, x)
                new.append(to)
            else:
                new.append(found)
        return pdf.assign(new_speaker_id=whole(new))

    out = _fold(rows, keys, order, "new_speaker_id int", step)
    return out.select(*segments.columns, "new_speaker_id")


def enrolled_similarities(phrases: DataFrame, roster: DataFrame) -> DataFrame:
    """Cosines with frozen centroids, in parallel before a fold."""
    return phrases.join(roster.select(F.col("name").alias("enrolled_name"), V.l2_normalize(F.col("centroid")).alias("__c"), "model_id"), "model_id").withColumn("similarity", V.cosine_similarity(F.col("embedding"), F.col("__c"))).drop("__c")
