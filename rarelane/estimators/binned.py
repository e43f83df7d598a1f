"""Tree learners on few features, all trained from one pass of bin counts.

A learner that sees one to three features sees nothing but how many rows of each
class fall into each cell of a small grid of feature bins.  Spark counts the
cells of every learner in one pass over the rows; after that a learner's data is
a few thousand counts however large the table is, and the learners are grown
side by side, one group each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Bins per feature, by the number of features a learner sees.
BINS = {1: 256, 2: 64, 3: 16}
# Learners counted in one pass: bounds the count table a task holds.
LEARNERS_PER_PASS = 1_000

# Default settings of boosted trees and of a single tree.
BOOST_DEFAULTS = {
    "n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "min_child_weight": 1.0,
    "reg_lambda": 1.0, "reg_alpha": 0.0, "gamma": 0.0, "subsample": 1.0,
    "colsample_bytree": 1.0, "random_state": 0,
}
TREE_DEFAULTS = {"max_depth": None, "min_samples_leaf": 1}


def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Inner edges of at most ``bins`` quantile bins per feature: one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    found = train.agg(*[
        F.percentile_approx(F.col(f).cast("double"), shares, 100 * bins).alias(f"e{i}")
        for i, f in enumerate(features)
    ]).first()
    return [np.unique(np.array(found[f"e{i}"], dtype=float)) for i in range(len(features))]


def cell_numbers(
    x: np.ndarray, members: tuple[int, ...], edges: list[np.ndarray], bins: int
) -> np.ndarray:
    """Grid cell of each row: a value v falls in the first bin whose edge is >= v."""
    cell = np.zeros(len(x), dtype=np.int64)
    for j in members:
        cell = cell * bins + np.searchsorted(edges[j], x[:, j], side="left")
    return cell


def count_cells(
    train: DataFrame, label: str, features: Sequence[str],
    members: Sequence[tuple[int, ...]], numbers: Sequence[int], edges: list[np.ndarray], bins: int,
) -> DataFrame:
    """``learner, cell, n0, n1`` for the occupied cells of the learners."""
    names = list(features)
    size = bins ** len(members[0])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(members), 2 * size))
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            y = batch["label"].to_numpy(dtype=np.int64)
            for n, columns in enumerate(members):
                cell = cell_numbers(x, columns, edges, bins)
                totals[n] += np.bincount(cell + size * y, minlength=2 * size)
        for n in range(len(members)):
            n0, n1 = totals[n, :size], totals[n, size:]
            used = np.nonzero(n0 + n1)[0]
            if len(used):
                yield pd.DataFrame({
                    "learner": int(numbers[n]), "cell": used, "n0": n0[used], "n1": n1[used],
                })

    parts = train.select(F.col(label).cast("int").alias("label"), *names).mapInPandas(
        count, "learner int, cell bigint, n0 double, n1 double"
    )
    return parts.groupBy("learner", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _grow(coords, grid, bins, a, b, gain, depth, columns):
    """Split greedily on two summed statistics; returns leaf numbers of counts and grid.

    ``gain(left_a, left_b, right_a, right_b)`` is the value of a split; only
    positive values split.
    """
    at, at_grid, nodes = np.zeros(len(coords), int), np.zeros(len(grid), int), 1
    for _ in range(depth):
        best = np.zeros(nodes)
        feature, edge = np.full(nodes, -1), np.zeros(nodes, int)
        for j in columns:
            where = at * bins + coords[:, j]
            left = [
                np.cumsum(np.bincount(where, weights=s, minlength=nodes * bins)
                          .reshape(nodes, bins), axis=1)
                for s in (a, b)
            ]
            right = [s[:, -1:] - s for s in left]
            value = gain(*left, *right)[:, :-1]
            spot = value.argmax(axis=1)
            top = value[np.arange(nodes), spot]
            better = top > best + 1e-12
            best, edge = np.where(better, top, best), np.where(better, spot, edge)
            feature = np.where(better, j, feature)
        split = np.nonzero(feature >= 0)[0]
        if not len(split):
            break
        right_of = np.full(nodes, -1)
        right_of[split] = nodes + np.arange(len(split))
        for place, points in ((at, coords), (at_grid, grid)):
            goes = (feature[place] >= 0) & (
                points[np.arange(len(points)), np.maximum(feature[place], 0)] > edge[place]
            )
            place[goes] = right_of[place[goes]]
        nodes += len(split)
    return at, at_grid, nodes


def boost_cells(coords, grid, bins, n0, n1, settings: Mapping[str, Any], seed: int) -> np.ndarray:
    """Log odds per grid cell from boosted trees on cell counts (Chen, Guestrin 2016)."""
    s = {**BOOST_DEFAULTS, **{k: v for k, v in settings.items() if k in BOOST_DEFAULTS}}
    lam, alpha, rate = float(s["reg_lambda"]), float(s["reg_alpha"]), float(s["learning_rate"])
    least = float(s["min_child_weight"])
    rng = np.random.default_rng([int(s["random_state"] or 0), seed])

    def cut(g):
        return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)

    def worth(g, h):
        return cut(g) ** 2 / np.maximum(h + lam, 1e-300)

    def gain(lg, lh, rg, rh):
        value = 0.5 * (worth(lg, lh) + worth(rg, rh) - worth(lg + rg, lh + rh)) - float(s["gamma"])
        return np.where((lh >= least) & (rh >= least), value, -np.inf)

    start = float(np.log(n1.sum() / n0.sum()))
    odds, odds_grid = np.full(len(coords), start), np.full(len(grid), start)
    width = coords.shape[1]
    kept = max(1, int(float(s["colsample_bytree"]) * width))
    for _ in range(int(s["n_estimators"])):
        w0, w1 = n0, n1
        if float(s["subsample"]) < 1.0:
            w0, w1 = (rng.binomial(n.astype(np.int64), float(s["subsample"])) for n in (n0, n1))
        p = 1.0 / (1.0 + np.exp(-odds))
        g, h = w0 * p - w1 * (1.0 - p), (w0 + w1) * p * (1.0 - p)
        columns = range(width) if kept == width else sorted(rng.permutation(width)[:kept])
        at, at_grid, nodes = _grow(coords, grid, bins, g, h, gain, int(s["max_depth"]), columns)
        sums = [np.bincount(at, weights=v, minlength=nodes) for v in (g, h)]
        leaf = -rate * cut(sums[0]) / np.maximum(sums[1] + lam, 1e-300)
        odds += leaf[at]
        odds_grid += leaf[at_grid]
    return odds_grid


def tree_cells(coords, grid, bins, n0, n1, settings: Mapping[str, Any], seed: int) -> np.ndarray:
    """Positive rows minus negative rows of each grid cell's leaf, split by Gini impurity."""
    s = {**TREE_DEFAULTS, **{k: v for k, v in settings.items() if k in TREE_DEFAULTS}}
    least = float(s["min_samples_leaf"])
    depth = 64 if s["max_depth"] is None else int(s["max_depth"])

    def impurity(a, b):
        return 2.0 * a * b / np.maximum(a + b, 1e-300)

    def gain(la, lb, ra, rb):
        value = impurity(la + ra, lb + rb) - impurity(la, lb) - impurity(ra, rb)
        return np.where((la + lb >= least) & (ra + rb >= least), value, -np.inf)

    at, at_grid, nodes = _grow(coords, grid, bins, n0, n1, gain, depth, range(coords.shape[1]))
    sums = [np.bincount(at, weights=v, minlength=nodes) for v in (n0, n1)]
    return (sums[1] - sums[0])[at_grid]


def vote_tables(
    counts: DataFrame, width: int, bins: int, kind: str, settings: Mapping[str, Any]
) -> DataFrame:
    """``learner, votes``: one -1/+1 per grid cell, learners grown side by side."""
    fit = boost_cells if kind == "xgb" else tree_cells
    fixed = dict(settings)

    def spread(cell: np.ndarray) -> np.ndarray:
        return np.stack([(cell // bins**j) % bins for j in reversed(range(width))], axis=1)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell")
        grid = spread(np.arange(bins**width))
        n0, n1 = part["n0"].to_numpy(), part["n1"].to_numpy()
        value = fit(spread(part["cell"].to_numpy()), grid, bins, n0, n1, fixed, int(key[0]))
        votes = np.where(value > 0, 1, -1).astype(np.int8)
        return pd.DataFrame({"learner": [int(key[0])], "votes": [votes.tobytes()]})

    return counts.groupBy("learner").applyInPandas(grow, "learner int, votes binary")


def fit_tables(
    train: DataFrame, label: str, features: Sequence[str], members: Sequence[tuple[int, ...]],
    kind: str, settings: Mapping[str, Any],
) -> tuple[dict[int, list[np.ndarray]], list[np.ndarray]]:
    """Edges by learner size and one vote table per learner.

    The collected tables hold at most 4,096 votes (one byte each) per learner.
    """
    sizes = sorted({len(m) for m in members})
    if sizes[-1] > max(BINS):
        raise ValueError(f"tree learners see at most {max(BINS)} features")
    edges = {size: bin_edges(train, features, BINS[size]) for size in sizes}
    tables: list[np.ndarray] = [np.empty(0)] * len(members)
    cores = train.sparkSession.sparkContext.defaultParallelism
    for size in sizes:
        numbers = [n for n, m in enumerate(members) if len(m) == size]
        for start in range(0, len(numbers), LEARNERS_PER_PASS):
            some = numbers[start : start + LEARNERS_PER_PASS]
            counts = count_cells(
                train, label, features, [members[n] for n in some], some, edges[size], BINS[size]
            )
            # Learners are compute-bound and tiny in bytes: set the task count.
            spread = counts.repartition(min(len(some), 4 * cores), "learner")
            grown = vote_tables(spread, size, BINS[size], kind, settings)
            for r in grown.collect():
                tables[r["learner"]] = np.frombuffer(r["votes"], dtype=np.int8)
    return edges, tables
