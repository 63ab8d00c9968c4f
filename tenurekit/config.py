"""Every date, threshold and run size of a study, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class StudyConfig:
    # The study's published settings.
    category: str = "Restaurants"
    window_start: date = date(2010, 1, 1)
    window_end: date = date(2019, 12, 31)
    churn_days: int = 365
    reactivation_days: int = 365
    min_actions: int = 2
    last_join: date = date(2018, 12, 31)
    train_join_end: date = date(2016, 12, 31)
    censor_thresholds: tuple[int, ...] = (90, 365)
    gap_probabilities: tuple[float, ...] = (0.50, 0.75, 0.90, 0.95, 0.99)
    clamp_probability: float = 0.99
    min_tenure_years: float = 1.0
    histogram_bins: int = 30
    train_rows: int = 100_000  # of the time-safe model; the full one learns from all
    train_seed: int = 123
    fold_seed: int = 42
    time_safe_fold_seed: int = 123
    sensitivity_rows: int = 50_000
    sensitivity_seed: int = 789
    alpha: float = 0.5
    n_folds: int = 5
    n_lambdas: int = 50
