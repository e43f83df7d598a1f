"""What all estimators share: fit on the train fold, score with columns.

``fit(train, key, label, features)`` returns a model; ``model.score(df)`` adds
``probability`` of the positive class and ``prediction`` (-1 or +1).  Labels are
0/1 inside.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rarelane.functions.text import number, quoted

LOG = logging.getLogger("rarelane")


def hard_label(probability: Column) -> Column:
    """-1 or +1; NULL where there is no probability."""
    return F.when(F.isnan(probability), None).when(probability > 0.5, 1).when(probability <= 0.5, -1)


def with_scores(df: DataFrame, probability: Column) -> DataFrame:
    return df.withColumn("probability", probability).withColumn(
        "prediction", hard_label(F.col("probability"))
    )


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def linear(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """Sum of weight times feature, plus bias; zero weights are left out."""
    terms = [f"{quoted(f)} * {number(w)}" for f, w in zip(features, weights) if w != 0.0]
    return F.expr(" + ".join([number(bias), *terms]))


def take_settings(given: Mapping[str, Any], known: Mapping[str, Any], unused: Sequence[str] = ()):
    """Defaults overlaid with the given settings; unknown names only warn."""
    for name in given:
        if name not in known and name not in unused:
            LOG.warning("setting %r is not known and is ignored", name)
        elif name in unused:
            LOG.info("setting %r has no effect here", name)
    return {name: given.get(name, value) for name, value in known.items()}


@dataclass(frozen=True)
class LinearModel:
    """probability = sigmoid(weights . features + bias)."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def margin(self) -> Column:
        return linear(self.features, self.weights, self.bias)

    def score(self, df: DataFrame) -> DataFrame:
        return with_scores(df, sigmoid(self.margin()))

    def parameters(self) -> list[tuple[str, str, float]]:
        rows = [("weight", f, w) for f, w in zip(self.features, self.weights)]
        return [*rows, ("bias", "", self.bias)]

    @staticmethod
    def on_scaled(features, offset, divisor, weights, bias) -> LinearModel:
        """Fold a scaler into the weights, so scoring reads raw features."""
        w = np.asarray(weights) / np.asarray(divisor)
        return LinearModel(
            tuple(features), tuple(map(float, w)), float(bias - w @ np.asarray(offset))
        )
