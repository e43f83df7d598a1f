"""k-nearest-neighbour classification: a neighbour join and a vote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rarelane.estimators.base import hard_label, take_settings
from rarelane.operators.neighbours import Metric, nearest_lists
from rarelane.operators.scale import Scaler, fit_scaler

# Default settings.
DEFAULTS = {"n_neighbors": 15, "weights": "distance", "p": 2, "metric": "minkowski"}
# Index structures of a single machine; they never change an answer.
UNUSED = ["algorithm", "leaf_size", "n_jobs"]


def vote(near: Column, label: str, weights: str) -> Column:
    """Positive share among the neighbours in a list of ``distance`` and label.

    With distance weights a neighbour counts 1/d; when some are at distance 0,
    only those count.
    """

    def share(part: Column, weight) -> Column:
        def total(value) -> Column:
            return F.aggregate(part, F.lit(0.0), lambda a, x: a + value(x))

        positive = total(lambda x: F.when(x[label] == 1, weight(x)).otherwise(0.0))
        return F.try_divide(positive, total(weight))

    if weights == "uniform":
        return share(near, lambda x: F.lit(1.0))
    if weights == "distance":
        exact = share(F.filter(near, lambda x: x["distance"] == 0), lambda x: F.lit(1.0))
        apart = F.filter(near, lambda x: x["distance"] > 0)
        return F.coalesce(exact, share(apart, lambda x: 1.0 / x["distance"]))
    raise ValueError(f"unknown weights {weights!r}: expected 'uniform' or 'distance'")


@dataclass(frozen=True)
class NeighbourModel:
    """The scaled train rows are the model."""

    table: DataFrame
    scaler: Scaler | None
    key: str
    label: str
    features: tuple[str, ...]
    k: int
    metric: Metric
    weights: str

    def neighbours(self, df: DataFrame) -> DataFrame:
        ask = df.select(self.key, *self.features)
        if self.scaler is not None:
            ask = self.scaler.transform(ask)
        return nearest_lists(
            ask, self.table, self.key, [self.features], self.k, self.metric, carry=[self.label]
        )

    def score(self, df: DataFrame) -> DataFrame:
        votes = self.neighbours(df).select(
            self.key, vote(F.col("near"), self.label, self.weights).alias("probability")
        )
        votes = votes.withColumn("prediction", hard_label(F.col("probability")))
        return df.join(votes, self.key)


def fit(
    train: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    settings: Mapping[str, Any],
    scale: bool = True,
) -> NeighbourModel:
    s = take_settings(settings, DEFAULTS, UNUSED)
    metric = Metric.named(s["metric"], s["p"])
    scaler = fit_scaler(train, features, "standard") if scale else None
    table = train.select(key, label, *features)
    if scaler is not None:
        table = scaler.transform(table)
    return NeighbourModel(
        table, scaler, key, label, tuple(features), int(s["n_neighbors"]), metric, s["weights"]
    )
