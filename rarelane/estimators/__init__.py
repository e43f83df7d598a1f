"""Estimators by name.  ``fit_model(name, ...)`` returns a model with ``score``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial
from typing import Any

from pyspark.sql import DataFrame

from rarelane.estimators import bayes, boosted, discriminant, ensemble, knn, logistic, trees

# The algorithm names of an experiment.
ESTIMATORS = {
    "knn": knn.fit,
    "lda": discriminant.fit,
    "logistic_regression": logistic.fit,
    "xgboost": boosted.fit_boosted,
    "classical_qboost": ensemble.fit,
    "cvqboost": ensemble.fit,
    "qiskit": partial(ensemble.fit, binary=True),
    "naive_bayes": bayes.fit,
    "decision_tree": trees.fit_tree,
}


def display_name(algorithm: str, settings: Mapping[str, Any]) -> str:
    """Name shown for a run."""
    weak = settings.get("weak_cls_type", "knn")
    # Display names.
    names = {
        "knn": "K-Nearest Neighbors",
        "lda": "Linear Discriminant Analysis",
        "logistic_regression": "Logistic Regression",
        "xgboost": "XGBoost",
        "classical_qboost":
            f"Classical QBoost ({weak} - {settings.get('optimization_method', 'L-BFGS-B')})",
        "cvqboost": f"CVQBoost ({weak})",
        "qiskit": "Qiskit QBoost",
        "naive_bayes": "Gaussian Naive Bayes",
        "decision_tree": "Decision Tree",
    }
    return names[algorithm]


def fit_model(
    algorithm: str,
    train: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    settings: Mapping[str, Any] | None = None,
):
    if algorithm not in ESTIMATORS:
        raise ValueError(f"unknown algorithm {algorithm!r}: expected one of {sorted(ESTIMATORS)}")
    return ESTIMATORS[algorithm](train, key, label, list(features), settings or {})
