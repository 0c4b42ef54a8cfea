"""Defaults of the topic pipeline; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Thresholds are strict bounds; times are epoch seconds."""

    seed: str = "42"
    min_score: int = 10
    min_length: int = 40
    start: int = 1199179770
    end: int = 1672531200
    reduced_dim: int = 5
    neighbours: int = 5
    max_features: int = 50_000
    top_words: int = 15
    sample_per_cluster: int = 50_000
    sample_per_subcluster: int = 5_000
    min_cluster_size: int = 10
    min_samples: int = 5
    quiz_size: int = 100
    quiz_options: int = 5
    quiz_runs: int = 5
    rows_per_file: int = 1_500_000
    link_base: str = "https://forum.example/r/"


DEFAULT = Config()
