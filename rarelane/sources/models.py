"""Fitted models on disk, as Parquet tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from rarelane.estimators.base import LinearModel
from rarelane.estimators.bayes import BayesModel
from rarelane.estimators.boosted import NODE_COLUMNS, BoostedModel, node_rows, trees_of
from rarelane.estimators.ensemble import (
    BinnedLearners, EnsembleModel, NeighbourLearners, SquareLearners,
)
from rarelane.estimators.knn import NeighbourModel
from rarelane.estimators.trees import TreeModel
from rarelane.operators.neighbours import Metric
from rarelane.operators.scale import Scaler


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write a model; ``load_model`` reads it back."""
    kind, facts = _facts(model)
    table = model if isinstance(model, NeighbourModel) else getattr(model, "learners", None)
    if isinstance(table, (NeighbourModel, NeighbourLearners)):
        table.table.write.mode("overwrite").parquet(f"{path}/table")
    if isinstance(model, (BoostedModel, TreeModel)):
        spark.createDataFrame(node_rows(model.trees), NODE_COLUMNS).write.mode("overwrite").parquet(f"{path}/trees")
    rows = [("kind", "", kind, None), *facts]
    schema = "part string, name string, text string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/facts"
    )


def _facts(model) -> tuple[str, list[tuple]]:
    listed = [("feature", str(i), f, None) for i, f in enumerate(getattr(model, "features", ()))]
    if isinstance(model, LinearModel):
        weights = [("weight", str(i), None, w) for i, w in enumerate(model.weights)]
        return "linear", [*listed, *weights, ("bias", "", None, model.bias)]
    if isinstance(model, BayesModel):
        rows = [("square", str(i), None, w) for i, w in enumerate(model.square)]
        rows += [("slope", str(i), None, w) for i, w in enumerate(model.slope)]
        rows += [("centre", str(i), None, w) for i, w in enumerate(model.centre)]
        return "bayes", [*listed, *rows, ("bias", "", None, model.bias)]
    if isinstance(model, TreeModel):
        return "tree", listed
    if isinstance(model, BoostedModel):
        return "boosted", listed
    if isinstance(model, NeighbourModel):
        scaler = model.scaler
        rows = [] if scaler is None else [
            *[("offset", str(i), None, v) for i, v in enumerate(scaler.offset)],
            *[("divisor", str(i), None, v) for i, v in enumerate(scaler.divisor)],
        ]
        return "neighbours", [*listed, *rows, *_neighbour_facts(model)]
    if isinstance(model, EnsembleModel):
        return _ensemble_facts(model)
    raise TypeError(f"cannot save a {type(model).__name__}")


def _neighbour_facts(model) -> list[tuple]:
    return [
        ("key", "", model.key, None), ("label", "", model.label, None),
        ("weights", "", model.weights, None), ("k", "", None, float(model.k)),
        ("p", "", None, float(model.metric.p)),
    ]


def _ensemble_facts(model: EnsembleModel) -> tuple[str, list[tuple]]:
    learners = model.learners
    rows = [("feature", str(i), f, None) for i, f in enumerate(learners.features)]
    for n, members in enumerate(learners.members):
        rows.append(("weight", str(n), ",".join(map(str, members)), float(model.weights[n])))
    if isinstance(learners, NeighbourLearners):
        return "ensemble_neighbours", [*rows, *_neighbour_facts(learners)]
    if isinstance(learners, BinnedLearners):
        for n, votes in enumerate(learners.tables):
            text = "".join("+" if v > 0 else "-" for v in votes)
            rows.append(("table", str(n), text, None))
        for size, edges in learners.edges.items():
            for j, ends in enumerate(edges):
                rows += [("edge", f"{size},{j},{e}", None, float(v)) for e, v in enumerate(ends)]
        return "ensemble_binned", rows
    for n, members in enumerate(learners.members):
        rows.append(("bias", str(n), None, float(learners.bias[n])))
        for j in members:
            rows.append(("slope", f"{n},{j}", None, float(learners.slope[n, j])))
            rows.append(("square", f"{n},{j}", None, float(learners.square[n, j])))
    rows += [("centre", str(j), None, float(v)) for j, v in enumerate(learners.centre)]
    return "ensemble_square", rows


def load_model(spark: SparkSession, path: str):
    """Read a model written by ``save_model``."""
    facts: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/facts").collect():
        facts.setdefault(r["part"], []).append((r["name"], r["text"], r["value"]))
    kind = facts["kind"][0][1]

    def listed(part: str, text: bool = False) -> tuple:
        rows = sorted(facts.get(part, []), key=lambda r: int(r[0]))
        return tuple(r[1] if text else r[2] for r in rows)

    def single(part: str):
        _, text, value = facts[part][0]
        return value if text is None else text

    features = listed("feature", text=True)
    if kind == "linear":
        return LinearModel(features, listed("weight"), single("bias"))
    if kind == "bayes":
        return BayesModel(features, listed("square"), listed("slope"), single("bias"), listed("centre"))
    if kind in ("boosted", "tree"):
        trees = trees_of(spark.read.parquet(f"{path}/trees").select(*_names(NODE_COLUMNS)).collect())
        return BoostedModel(features, trees) if kind == "boosted" else TreeModel(features, trees[0])
    if kind == "neighbours":
        offset = listed("offset")
        scaler = Scaler("standard", features, offset, listed("divisor")) if offset else None
        return NeighbourModel(
            spark.read.parquet(f"{path}/table"), scaler, single("key"), single("label"), features,
            int(single("k")), Metric(single("p")), single("weights"),
        )
    members = [tuple(map(int, m.split(","))) for m in listed("weight", text=True)]
    weights = np.array(listed("weight"))
    if kind == "ensemble_neighbours":
        learners = NeighbourLearners(
            features, members, spark.read.parquet(f"{path}/table"), single("key"),
            single("label"), int(single("k")), Metric(single("p")), single("weights"),
        )
        return EnsembleModel(learners, weights, {})
    if kind == "ensemble_binned":
        return EnsembleModel(_binned(facts, features, members, listed), weights, {})
    shape = (len(members), len(features))
    slope, square = np.zeros(shape), np.zeros(shape)
    for part, target in (("slope", slope), ("square", square)):
        for name, _, value in facts[part]:
            n, j = map(int, name.split(","))
            target[n, j] = value
    learners = SquareLearners(features, members, square, slope, np.array(listed("bias")), np.array(listed("centre")))
    return EnsembleModel(learners, weights, {})


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _binned(facts, features, members, listed) -> BinnedLearners:
    ends: dict[tuple[int, int], dict[int, float]] = {}
    for name, _, value in facts.get("edge", []):
        size, j, e = map(int, name.split(","))
        ends.setdefault((size, j), {})[e] = value
    edges = {
        size: [
            np.array([v for _, v in sorted(ends.get((size, j), {}).items())])
            for j in range(len(features))
        ]
        for size in {len(m) for m in members}
    }
    tables = [
        np.array([1 if c == "+" else -1 for c in text], dtype=np.int8)
        for text in listed("table", text=True)
    ]
    return BinnedLearners(features, members, edges, tables)
