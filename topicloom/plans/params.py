"""Thresholds of the two drivers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    match_threshold: float = 0.6
    sample_ratio: float = 0.01
    sample_least: int = 10
    sample_most: int = 100
    cluster_score: float = 10.0
    split_threshold: float = 0.5
    merge_threshold: float = 0.1
    new_concepts: int = 5
    rounds: int = 5
    weights: tuple[float, float] = (0.8, 0.2)
    topic_to_attr: float = 0.5
    topics_per_attr: int = 4
    ngram_threshold: float = 0.6
    sentence: int = 30
    value_sample: int = 100
    table_similarity: float = 0.4
    transfer: float = 0.5
    parity: bool = False
