"""Run parameters. Defaults are the values a run is configured with today."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # fixed values
    pos_label: int = 1
    number_of_features: int = 500  # the label counts as one
    n_outer_folds: int = 6
    n_inner_folds: int = 5
    seed: int = 42
    lambda_start: float = -3.0
    lambda_end: float = 3.0
    interval_parameter: int = 7
    train_correlation_threshold: float = 0.3
    target_scale: float = 100.0
    top_n: int = 20
    node_ids: tuple[str, ...] = ("node4", "node3", "node1")
    # seconds between two power samples, by workflow element
    sampling_interval: dict[str, int] = field(
        default_factory=lambda: {"preprocessing": 1, "feature_selection": 60}
    )
    cv_aggregators: tuple[str, ...] = ("ArithmeticMean",)
    ensemble_aggregators: tuple[str, ...] = (
        "Sum",
        "SumRanked",
        "ArithmeticMean",
        "ArithmeticMeanRanked",
        "Count",
        "CountRanked",
        "BordaCount",
        "ReciprocalRanking",
        "FeatureOccurrenceFrequency",
    )
    lasso_trials: int = 30
    forest_trials: int = 100
    boosting_trials: int = 100
    reverse_lasso_trials: int = 30
    reverse_forest_trials: int = 50
