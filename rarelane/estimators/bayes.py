"""Gaussian naive Bayes: one aggregate, scored by arithmetic."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rarelane.estimators.base import sigmoid, take_settings, with_scores
from rarelane.estimators.moments import ClassMoments
from rarelane.functions.text import number, quoted

# Fixed value: share of the largest feature variance added to every variance.
DEFAULTS = {"var_smoothing": 1e-9}


@dataclass(frozen=True)
class BayesModel:
    """Log odds are a square form per feature: bias + sum(a * x^2 + b * x), x counted from the centre.

    The centre is the mean of all train rows: far from it the squares of a feature
    with a large offset would leave no digits for the difference of the classes.
    """

    features: tuple[str, ...]
    square: tuple[float, ...]
    slope: tuple[float, ...]
    bias: float
    centre: tuple[float, ...]

    def margin(self) -> Column:
        terms = [
            f"({quoted(f)} - {number(m)}) * ({number(a)} * ({quoted(f)} - {number(m)}) + {number(b)})"
            for f, a, b, m in zip(self.features, self.square, self.slope, self.centre)
        ]
        return F.expr(" + ".join([number(self.bias), *terms]))

    def score(self, df: DataFrame) -> DataFrame:
        return with_scores(df, sigmoid(self.margin()))

    def parameters(self) -> list[tuple[str, str, float]]:
        rows = [("square", f, v) for f, v in zip(self.features, self.square)]
        rows += [("slope", f, v) for f, v in zip(self.features, self.slope)]
        rows += [("centre", f, v) for f, v in zip(self.features, self.centre)]
        return [*rows, ("bias", "", self.bias)]


def log_odds(
    counts: np.ndarray, means: np.ndarray, variances: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of x^2, of x, and the constant, class 1 against class 0."""
    square = 0.5 / variances[0] - 0.5 / variances[1]
    slope = means[1] / variances[1] - means[0] / variances[0]
    constant = 0.5 * (
        np.log(variances[0] / variances[1]) + means[0] ** 2 / variances[0]
        - means[1] ** 2 / variances[1]
    )
    return square, slope, float(constant.sum() + math.log(counts[1] / counts[0]))


def class_spread(train: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Per class the row count and each feature's mean and population variance."""
    return train.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.expr(f"array({', '.join(f'{how}({quoted(f)})' for f in features)})").alias(name)
            for how, name in (("avg", "means"), ("var_pop", "variances"))
        ],
    )


def smooth_variances(
    counts: np.ndarray, means: np.ndarray, variances: np.ndarray, share: float
) -> np.ndarray:
    weight = (counts / counts.sum())[:, None]
    centre = (weight * means).sum(axis=0)
    overall = (weight * (variances + (means - centre) ** 2)).sum(axis=0)
    return variances + share * overall.max()


def fit(
    train: DataFrame, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any]
) -> BayesModel:
    s = take_settings(settings, DEFAULTS)
    rows = {r["label"]: r for r in class_spread(train, label, features).collect()}
    if set(rows) != {0, 1}:
        raise ValueError("the train fold must hold both classes")
    counts = np.array([rows[c]["n"] for c in (0, 1)], dtype=float)
    means = np.array([rows[c]["means"] for c in (0, 1)])
    variances = np.array([rows[c]["variances"] for c in (0, 1)])
    variances = smooth_variances(counts, means, variances, s["var_smoothing"])
    centre = counts @ means / counts.sum()
    square, slope, bias = log_odds(counts, means - centre, variances)
    return BayesModel(
        tuple(features), tuple(map(float, square)), tuple(map(float, slope)), bias, tuple(map(float, centre))
    )


def fit_from_moments(moments: ClassMoments, share: float = DEFAULTS["var_smoothing"]):
    """The same coefficients, counted from the moments' centre, from class moments already at hand."""
    variances = np.maximum(np.einsum("cii->ci", moments.covariances), 0.0)
    variances = smooth_variances(moments.counts, moments.means, variances, share)
    return log_odds(moments.counts, moments.means - moments.centre, variances)
