"""Logistic regression of many learners at once, by proximal Newton steps.

A pass over the rows gives every learner's loss, slope and curvature at its trial weights,
added up over tasks by block.  A trial that did not lower a learner's objective is taken
back half way; else its next step minimises the quadratic model plus the penalties, exactly:
for l1 by cyclic soft thresholds on the small matrix.  The constant is not penalised.

Objective: sum of weight x log loss + l2 / 2 |w|^2 + l1 |w|_1.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rarelane.estimators.base import LOG
from rarelane.estimators.gram import SIDE, add_blocks
from rarelane.functions.text import quoted

#: Rows worked on at once; cycles of thresholds in one step; halvings before a learner is left as it is.
ROWS, CYCLES, HALVINGS = 2_000, 500, 30
#: A step's longest part.
LONGEST = 20.0


def penalties(settings: Mapping[str, Any]) -> tuple[float, float]:
    """(l1, l2) strengths from ``penalty``, ``C`` and ``l1_ratio``."""
    kind, ratio = settings["penalty"], settings.get("l1_ratio")
    if kind in (None, "none"):
        return 0.0, 0.0
    shares = {"l2": 0.0, "l1": 1.0, "elasticnet": ratio}
    if kind not in shares:
        raise ValueError(f"unknown penalty {kind!r}")
    if shares[kind] is None:
        raise ValueError("the penalty 'elasticnet' needs l1_ratio")
    strength = 1.0 / float(settings["C"])
    return strength * float(shares[kind]), strength * (1.0 - float(shares[kind]))


def _sums(rows: DataFrame, columns: np.ndarray, m: int, theta: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Per learner a matrix: curvature (size + 1 square), then columns of slopes and of the loss."""
    n, size = columns.shape

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((n, m + 1))
        for k in range(size):
            weights[np.arange(n), columns[:, k]] += theta[:, k]
        learner = np.arange(n)
        total = np.zeros((n, size + 1, size + 3))
        for batch in batches:
            whole = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)]
            every = np.column_stack([*whole, np.zeros(batch.num_rows)])
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(every), ROWS):
                x, y = every[start : start + ROWS], labels[start : start + ROWS][:, None]
                margin = x @ weights.T + theta[:, size]
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                row = heavy[y[:, 0].astype(int)][:, None]
                r, w = row * (p - y), row * p * (1.0 - p)
                rx, wx, wxx = r.T @ x, w.T @ x, w.T @ (x * x)
                total[:, size, -2] += r.sum(axis=0)
                total[:, size, size] += w.sum(axis=0)
                total[:, 0, -1] += (row * (np.logaddexp(0.0, margin) - y * margin)).sum(axis=0)
                if n == 1:
                    total[0, :size, :size] += (x[:, columns[0]] * w).T @ x[:, columns[0]]
                for k in range(size):
                    ck = columns[:, k]
                    total[:, k, -2] += rx[learner, ck]
                    total[:, k, size] += wx[learner, ck]
                    total[:, size, k] += wx[learner, ck]
                    if n == 1:
                        continue
                    total[:, k, k] += wxx[learner, ck]
                    for other in range(k):
                        mixed = (w * x[:, ck] * x[:, columns[:, other]]).sum(axis=0)
                        total[:, k, other] += mixed
                        total[:, other, k] += mixed
        flat, step = total.ravel(), SIDE * SIDE
        lots = range(0, len(flat), step)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(lots)), pa.int32()), pa.array([0] * len(lots), pa.int32()),
             pa.array([flat[at : at + step].tobytes() for at in lots], pa.binary())],
            ["bi", "bj", "data"],
        )

    found = add_blocks(rows.mapInArrow(make, "bi int, bj int, data binary")).collect()
    flat = np.concatenate([np.frombuffer(r["data"], "<f8") for r in sorted(found, key=lambda r: r["bi"])] or [np.zeros(n * (size + 1) * (size + 3))])
    return flat.reshape(n, size + 1, size + 3)


def _step(theta: np.ndarray, slope: np.ndarray, curve: np.ndarray, l1: float) -> np.ndarray:
    """Weights that minimise the quadratic model around ``theta`` plus l1 times their size (not the constant's)."""
    size = theta.shape[1] - 1
    if not l1:
        return theta - np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    out = theta.copy()
    gradient = slope.copy()  # of the model at ``out``
    for _ in range(CYCLES):
        largest = 0.0
        for k in range(size + 1):
            own = curve[:, k, k]
            wanted = out[:, k] - gradient[:, k] / own
            if k < size:
                wanted = np.sign(wanted) * np.maximum(np.abs(wanted) - l1 / own, 0.0)
            move = wanted - out[:, k]
            gradient += curve[:, :, k] * move[:, None]
            out[:, k] = wanted
            largest = max(largest, float(np.abs(move).max(initial=0.0)))
        if largest < 1e-12:
            break
    return out


def fit_learners(
    train: DataFrame, label: str, features: Sequence[str], members: Sequence[tuple[int, ...]],
    heavy: np.ndarray, l1: float, l2: float, max_iter: int, tol: float,
) -> np.ndarray:
    """Weights of each learner's members and its constant, a row per learner; short rows are padded with zeros before it.

    ``heavy``: weight of the rows of label 0 and of label 1.
    """
    m, n, size = len(features), len(members), max(map(len, members))
    # short subsets are padded with an all-zero column, number m
    columns = np.array([[*c, *[m] * (size - len(c))] for c in members])
    padded = columns == m
    rows = train.select(
        F.col(quoted(label)).cast("double").alias("label"),
        *[F.col(quoted(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )
    inner = np.arange(size)
    best, trial = np.zeros((n, size + 1)), np.zeros((n, size + 1))
    least, target = np.full(n, np.inf), np.zeros((n, size + 1))
    share, done = np.ones(n), np.zeros(n, bool)
    for _ in range(max_iter):
        total = _sums(rows, columns, m, trial, heavy)
        own = trial[:, :size]
        value = total[:, 0, -1] + 0.5 * l2 * (own * own).sum(axis=1) + l1 * np.abs(own).sum(axis=1)
        better = (value <= least + 1e-12 * np.abs(least)) | ~np.isfinite(least)
        better &= ~done
        curve, slope = total[:, :, : size + 1].copy(), total[:, :, -2].copy()
        slope[:, :size] += l2 * own
        curve[:, inner, inner] += l2 + padded  # padded columns have no data: a unit diagonal keeps them at zero
        curve += 1e-12 * np.eye(size + 1)
        following = _step(trial, slope, curve, l1)
        move = following - trial
        longest = np.abs(move).max(axis=1)
        following = trial + move * np.minimum(1.0, LONGEST / np.maximum(longest, 1e-300))[:, None]
        still = longest < tol * np.maximum(1.0, np.abs(trial).max(axis=1))
        best[better], least[better], target[better], share[better] = trial[better], value[better], following[better], 1.0
        worse = ~better & ~done
        share[worse] /= 2.0
        done |= (better & still) | (worse & (share < 0.5**HALVINGS))
        if done.all():
            break
        trial = np.where(done[:, None], best, best + (target - best) * share[:, None])
    else:
        LOG.warning("logistic learners still move after %s steps", max_iter)
    best[:, :size][padded] = 0.0
    return best
