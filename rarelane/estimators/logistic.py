"""Logistic regression with per-sample loss strength ``C``: one learner of :mod:`newton`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rarelane.estimators import newton
from rarelane.estimators.base import LinearModel, take_settings
from rarelane.operators.scale import fit_scaler
from rarelane.session import stage_table

# Default settings.
DEFAULTS = {
    "penalty": "l2",
    "C": 0.5,
    "solver": "lbfgs",
    "max_iter": 2000,
    "class_weight": "balanced",
    "tol": 1e-4,
    "random_state": 228,
    "l1_ratio": None,
}


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with weight = all rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class is left, so a window over all of them is small.
    whole = Window.partitionBy()
    share = F.sum("n").over(whole) / (F.count("n").over(whole) * F.col("n"))
    return counts.select(label, "n", share.alias("weight"))


def fit(
    train: DataFrame, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any]
) -> LinearModel:
    s = take_settings(settings, DEFAULTS)
    scaler = fit_scaler(train, features, "standard")
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError("the train fold must hold both classes")
    rows = sum(counts.values())
    weights = {c: rows / (2 * n) for c, n in counts.items()}
    if s["class_weight"] is None:
        weights = {c: 1.0 for c in counts}
    elif isinstance(s["class_weight"], Mapping):
        weights = {c: float(s["class_weight"].get(c, 1.0)) for c in counts}
    l1, l2 = newton.penalties(s)
    scaled = stage_table(scaler.transform(train.select(label, *features)), "scaled")
    whole = [tuple(range(len(features)))]
    theta = newton.fit_learners(
        scaled, label, features, whole, np.array([weights[0], weights[1]]), l1, l2, int(s["max_iter"]), float(s["tol"]) * 1e-3
    )[0]
    return LinearModel.on_scaled(features, scaler.offset, scaler.divisor, theta[:-1], theta[-1])
