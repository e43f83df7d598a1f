"""Linear discriminant analysis from one pass of class moments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from rarelane.estimators.base import LinearModel, take_settings
from rarelane.estimators.moments import ClassMoments, class_moments
from rarelane.functions.text import number, quoted
from rarelane.operators.scale import Scaler, fit_scaler

# Default settings.
DEFAULTS = {"solver": "lsqr", "shrinkage": "auto", "tol": 1e-4}
# Directions with less than this share of the largest variance count as empty.
RANK_CUT = 1e-12


def _solve(cov: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(cov, rcond=RANK_CUT, hermitian=True) @ gap


def shrink(cov: np.ndarray, amount: float) -> np.ndarray:
    """(1 - s) * cov + s * mean variance * identity."""
    size = len(cov)
    return (1.0 - amount) * cov + amount * np.trace(cov) / size * np.eye(size)


def _auto_shrunk(
    train: DataFrame, label: str, moments: ClassMoments, scaler: Scaler
) -> list[np.ndarray]:
    """Ledoit-Wolf shrinkage per class on columns scaled within the class.

    Needs the sum over rows of the squared norm squared: one more aggregate, on
    already centred values.
    """
    spread = np.sqrt(np.einsum("cii->ci", moments.covariances))
    spread[spread <= 0] = 1.0
    norms = []
    for c in (0, 1):
        norm = " + ".join(
            f"pow(({scaler.text(f)} - {number(moments.means[c, i])}) / {number(spread[c, i])}, 2)"
            for i, f in enumerate(moments.features)
        )
        norms.append(f"sum(CASE WHEN {quoted(label)} = {c} THEN pow({norm}, 2) END) AS q{c}")
    quartic = train.selectExpr(*norms).first()
    shrunk = []
    for c in (0, 1):
        scale = np.outer(spread[c], spread[c])
        part = auto_shrink(moments.covariances[c] / scale, quartic[c], moments.counts[c])
        shrunk.append(part * scale)
    return shrunk


def auto_shrink(s: np.ndarray, quartic: float, rows: float) -> np.ndarray:
    """Ledoit-Wolf: weigh the noise of the entries against their spread around mu * I."""
    size = len(s)
    mu = np.trace(s) / size
    square = (s * s).sum()
    gap = (square - size * mu * mu) / size
    noise = min((quartic / rows - square) / (size * rows), gap)
    return shrink(s, noise / gap if noise > 0 else 0.0)


def discriminant(
    moments: ClassMoments,
    solver: str = "lsqr",
    tol: float = 1e-4,
    covariances: Sequence[np.ndarray] | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and bias on the features the moments were taken of."""
    mean0, mean1 = moments.means
    prior0, prior1 = moments.priors
    gap = mean1 - mean0
    covs = moments.covariances if covariances is None else covariances
    within = prior0 * covs[0] + prior1 * covs[1]
    if solver == "svd":
        weights = _svd_weights(moments, within, gap, tol)
    elif solver in ("lsqr", "eigen"):
        weights = _solve(within, gap)
    else:
        raise ValueError(f"unknown solver {solver!r}: expected 'lsqr', 'eigen' or 'svd'")
    bias = -0.5 * float((mean0 + mean1) @ weights) + float(np.log(prior1 / prior0))
    return weights, bias


def _svd_weights(
    moments: ClassMoments, within: np.ndarray, gap: np.ndarray, tol: float
) -> np.ndarray:
    """Pooled covariance with divisor n - 2; directions below ``tol`` are dropped.

    Singular values of the centred, scaled rows are the roots of the
    eigenvalues of the pooled correlation matrix.
    """
    n = moments.counts.sum()
    spread = np.sqrt(np.diag(within))
    spread[spread <= 0] = 1.0
    values, vectors = np.linalg.eigh(within / np.outer(spread, spread) * n / (n - 2))
    keep = np.sqrt(np.maximum(values, 0.0)) > tol
    axes = vectors[:, keep] / spread[:, None]
    return axes @ ((axes.T @ gap) / values[keep])


def fit(
    train: DataFrame, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any]
) -> LinearModel:
    s = take_settings(settings, DEFAULTS)
    scaler = fit_scaler(train, features, "standard")
    moments = class_moments(train, label, features, scaler)
    covs: Sequence[np.ndarray] | None = None
    amount = s["shrinkage"]
    if amount is not None and s["solver"] == "svd":
        raise ValueError("shrinkage is not available with solver 'svd'")
    if amount == "auto":
        covs = _auto_shrunk(train, label, moments, scaler)
    elif amount is not None:
        covs = [shrink(c, float(amount)) for c in moments.covariances]
    weights, bias = discriminant(moments, s["solver"], s["tol"], covs)
    return LinearModel.on_scaled(features, scaler.offset, scaler.divisor, weights, bias)
