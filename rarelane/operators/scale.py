"""Feature scaling fitted on the train fold only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rarelane.functions.text import double, number, quoted


@dataclass(frozen=True)
class Scaler:
    """Per feature an offset and a divisor: (x - offset) / divisor."""

    kind: str
    features: tuple[str, ...]
    offset: tuple[float, ...]
    divisor: tuple[float, ...]

    def text(self, feature: str) -> str:
        i = self.features.index(feature)
        return f"({quoted(feature)} - {number(self.offset[i])}) / {number(self.divisor[i])}"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(*[
            f"{self.text(c)} AS {quoted(c)}" if c in self.features else quoted(c)
            for c in df.columns
        ])


def fit_scaler(train: DataFrame, features: Sequence[str], kind: str) -> Scaler:
    """One aggregate over the train fold; a constant feature is divided by 1."""
    if kind == "minmax":
        low, high = "min", "max"
    elif kind == "standard":
        low, high = "avg", "stddev_pop"
    else:
        raise ValueError(f"unknown scaling {kind!r}: expected 'none', 'minmax' or 'standard'")
    a, b = (", ".join(f"{f}({double(c)})" for c in features) for f in (low, high))
    row = train.selectExpr(f"array({a}) AS a", f"array({b}) AS b").first()
    if any(v is None for v in row["a"]):
        empty = [f for f, v in zip(features, row["a"]) if v is None]
        raise ValueError(f"no values to scale by in the train fold: {empty}")
    width = [b - a for a, b in zip(row["a"], row["b"])] if kind == "minmax" else row["b"]
    return Scaler(kind, tuple(features), tuple(row["a"]), tuple(w if w > 0 else 1.0 for w in width))


def scale_folds(df: DataFrame, features: Sequence[str], kind: str, fold: str = "fold") -> DataFrame:
    """Fit on ``fold = 'train'`` and apply to both folds."""
    if kind == "none":
        return df
    return fit_scaler(df.where(F.col(fold) == "train"), features, kind).transform(df)
