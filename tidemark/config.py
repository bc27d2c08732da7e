"""Thresholds of the jobs, as frozen dataclasses. Fixed values where results must agree with the domain's rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PricingConfig:
    window_days: tuple[int, ...] = (7, 30, 90, 180)
    fresh_hours: int = 6
    aging_hours: int = 24
    min_count: int = 2
    stable_percent: float = 2.0


@dataclass(frozen=True)
class SalesConfig:
    drop_percent: int = 10
    max_gap_days: int = 2
    min_listings: int = 2
    high_listings: int = 5
    medium_listings: int = 2


@dataclass(frozen=True)
class MatchingConfig:
    weight_identifier: float = 0.45
    weight_attributes: float = 0.35
    weight_title: float = 0.12
    weight_embedding: float = 0.08
    title_high: float = 0.82
    title_medium: float = 0.60
    embedding_high: float = 0.86
    embedding_medium: float = 0.72
    same_min: float = 0.78
    possible_min: float = 0.52
    review_min: float = 0.34
    token_ratio: float = 0.84
    hint_ratio: float = 0.86
    dimension: int = 256
    max_block: int = 200  # left listings in a piece of a block; larger blocks are cut into pieces, none is dropped
    left_block: int = 512  # listings in a block of the search for the best among different products: bounds what a task holds
    right_block: int = 4096


@dataclass(frozen=True)
class RecommendConfig:
    buy_percentile: float = 25.0
    buy_strong_percentile: float = 15.0
    near_low_percent: int = 5
    near_low_strong_percent: int = 2
    wait_percentile: float = 70.0
    min_saving_percent: float = 5.0
    min_above_percent: float = 5.0
    min_prediction_confidence: float = 0.5
    horizon_days: int = 30
    min_observations: int = 3


@dataclass(frozen=True)
class ModelConfig:
    train_fraction: float = 0.70
    validation_fraction: float = 0.15
    min_train: int = 20
    min_validation: int = 6
    min_test: int = 6
    rounds: int = 80
    depth: int = 3
    rate: float = 0.1
    seed: int = 42
