"""Class means and covariances in one pass over the train fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rarelane.functions.text import double, number, quoted
from rarelane.operators.scale import Scaler

# Up to this many features the products are summed by plain aggregates; beyond
# it, one matrix product per Arrow batch is cheaper.
SQL_FEATURES = 10


@dataclass(frozen=True)
class ClassMoments:
    """Per class (0 then 1): rows, mean vector and population covariance; the centre of all rows."""

    features: tuple[str, ...]
    counts: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    centre: np.ndarray

    @property
    def priors(self) -> np.ndarray:
        return self.counts / self.counts.sum()

    def subset(self, columns: Sequence[int]) -> ClassMoments:
        pick = list(columns)
        return ClassMoments(
            tuple(self.features[i] for i in pick),
            self.counts,
            self.means[:, pick],
            self.covariances[:, pick][:, :, pick],
            self.centre[pick],
        )


def product_sums(train: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Long table ``(label, i, j, total)``: sums of x_i * x_j, with x_0 = 1.

    Row (0, 0) is the class count and rows (0, j) are the plain sums.
    """
    if len(features) <= SQL_FEATURES:
        return _sums_by_aggregate(train, label, features)
    return _sums_by_batch(train, label, features)


def _sums_by_aggregate(train: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    x = ["1.0D", *[double(f) for f in features]]
    cells = ", ".join(
        f"named_struct('i', {i}, 'j', {j}, 'total', sum({x[i]} * {x[j]}))"
        for i in range(len(x)) for j in range(i, len(x))
    )
    wide = train.groupBy(F.col(label).alias("label")).agg(F.expr(f"array({cells})").alias("cells"))
    return wide.select("label", F.inline("cells"))


def _sums_by_batch(train: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    names = list(features)
    m = len(names) + 1
    upper = np.triu_indices(m)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch["label"].to_numpy()
            x = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(dtype=float)])
            for c in np.unique(y):
                part = x[y == c]
                sums[c] = sums.get(c, 0.0) + part.T @ part
        for c, total in sums.items():
            yield pd.DataFrame(
                {"label": c, "i": upper[0], "j": upper[1], "total": total[upper]}
            )

    parts = train.select(F.col(label).cast("int").alias("label"), *names).mapInPandas(
        multiply, "label int, i int, j int, total double"
    )
    return parts.groupBy("label", "i", "j").agg(F.sum("total").alias("total"))


def class_moments(
    train: DataFrame, label: str, features: Sequence[str], scaler: Scaler | None = None
) -> ClassMoments:
    """Moments of the (scaled) features; the collected table is (m + 1)^2 numbers per class.

    Products are summed of features counted from their overall mean, found first: a
    feature with a large offset keeps its digits.
    """
    data = train.select(label, *features)
    if scaler is not None:
        data = scaler.transform(data)
    found = data.agg(*[F.expr(f"avg({double(f)})").alias(str(i)) for i, f in enumerate(features)]).first()
    centre = np.array([0.0 if v is None or not np.isfinite(v) else v for v in found])
    data = data.selectExpr(
        quoted(label), *[f"{double(f)} - {number(v)} AS {quoted(f)}" for f, v in zip(features, centre)]
    )
    m = len(features) + 1
    sums = np.zeros((2, m, m))
    for r in product_sums(data, label, features).collect():
        if r["label"] not in (0, 1):
            raise ValueError(f"labels must be 0 or 1, found {r['label']}")
        if r["total"] is None or np.isnan(r["total"]):
            raise ValueError("NULL values in model inputs")
        sums[r["label"], r["i"], r["j"]] = sums[r["label"], r["j"], r["i"]] = r["total"]
    counts = sums[:, 0, 0]
    if not counts.all():
        raise ValueError("the train fold holds one class only")
    means = sums[:, 0, 1:] / counts[:, None]
    cov = sums[:, 1:, 1:] / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    return ClassMoments(tuple(features), counts, means + centre, cov, centre)
