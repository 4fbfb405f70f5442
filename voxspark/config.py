"""Thresholds, as dataclasses that become literals of a plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Clustering:
    similarity: float = 0.75
    minimum: float = 0.5
    margin: float = 0.15
    num_speakers: int = 2


@dataclass(frozen=True)
class Inference:
    min_segments: int = 3
    min_occurrences: int = 2
    boost: float = 1.10
    unknown_boost: float = 1.05
    eligible_rank: int = 2
    min_after_boost: float = 0.75
    ambiguity_margin: float = 0.18
    confident: float = 0.82
    min_for_boost: float = 0.65
    unexpected: float = 0.70
    final_margin: float = 0.15
    expected_speakers: int = 2


@dataclass(frozen=True)
class UnknownClustering:
    similarity: float = 0.75
    max_unknown: int = 4
    min_segments: int = 2


@dataclass(frozen=True)
class Overlap:
    min_match: int = 2
    threshold: float = 0.8
    max_words: int = 12


UNKNOWN_SPEAKER = -1
UNKNOWN_BASE = -100
SAMPLE_RATE = 16_000
