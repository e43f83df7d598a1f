"""Proof that 0/1 weights are the best: branch and bound over rows of open cases.

A case fixes some weights at 0 or 1.  The least energy of the rest, with weights anywhere
between 0 and 1, is a lower bound; as x^2 = x for 0 and 1, the diagonal is first lowered by
the smallest eigenvalue and the linear part raised by it, which keeps every choice's energy
and makes the bound as tight as a uniform shift can.  A bound holds for any trial weights:
their energy, less the most that a step along the slope could gain in the box.

Open cases are Spark rows.  A task looks into a case depth first, up to CASES cases, and
hands back what is still open, so the next round spreads it.  Rounds end when nothing is open
that could beat the best choice, or at ROUNDS; then the least open bound gives the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rarelane.session import stage_table

#: Cases a task looks into per open case and round, and rounds.
CASES, ROUNDS = 400, 12
#: Trial steps of a bound.
STEPS = 60
#: Energies that differ by less are equal.
EQUAL = 1e-6


class Energy:
    """x'Jx + c'x over 0/1 weights, with the diagonal shifted."""

    def __init__(self, j: np.ndarray, c: np.ndarray):
        ends = np.linalg.eigvalsh(j)
        shift = max(float(ends[0]), 0.0) * (1 - 1e-9)
        self.q, self.linear = j - shift * np.eye(len(c)), c + shift
        self.steepest = 2.0 * max(float(ends[-1]) - shift, 1e-12)

    def of(self, x: np.ndarray) -> float:
        return float(x @ self.q @ x + self.linear @ x)

    def bound(self, fixed: np.ndarray, enough: float) -> tuple[float, np.ndarray]:
        """Lower bound of a case (-1: open), and trial weights; may stop at a bound of ``enough``."""
        free, ones = np.flatnonzero(fixed < 0), fixed > 0
        q = self.q[np.ix_(free, free)]
        linear = self.linear[free] + 2.0 * self.q[np.ix_(free, np.flatnonzero(ones))].sum(axis=1)
        start = float(self.q[np.ix_(ones, ones)].sum() + self.linear[ones].sum())
        w = np.full(len(free), 0.5)
        ahead, t, best = w.copy(), 1.0, -np.inf
        for step in range(STEPS):
            moved = np.clip(ahead - (2.0 * (q @ ahead) + linear) / self.steepest, 0.0, 1.0)
            after = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
            ahead, w, t = moved + (t - 1.0) / after * (moved - w), moved, after
            if step % 5 == 4 or step == STEPS - 1:
                slope = 2.0 * (q @ w) + linear
                value = start + float(w @ q @ w + linear @ w) - float(np.maximum(slope * w, slope * (w - 1.0)).sum())
                best = max(best, value)
                if best >= enough:
                    break
        whole = fixed.astype(float)
        whole[free] = w
        return (best if len(free) else start), whole


def search(energy: Energy, fixed: np.ndarray, best: float, cases: int) -> tuple[float, np.ndarray | None, list]:
    """Best energy and choice found below a case, and the (case, bound) that are still open."""
    stack, choice = [(fixed, -np.inf)], None
    while stack and cases > 0:
        fixed, _ = stack.pop()
        cases -= 1
        bound, weights = energy.bound(fixed, best - EQUAL)
        if bound >= best - EQUAL:
            continue
        rounded = np.where(weights > 0.5, 1.0, 0.0)
        if (found := energy.of(rounded)) < best - EQUAL:
            best, choice = found, rounded
        free = np.flatnonzero(fixed < 0)
        if not len(free):
            continue
        at = free[np.abs(weights[free] - 0.5).argmin()]
        for value in (0, 1) if weights[at] > 0.5 else (1, 0):  # the likelier side is looked into first
            child = fixed.copy()
            child[at] = value
            stack.append((child, bound))
    return best, choice, [x for x in stack if x[1] < best - EQUAL]


def proven_choice(spark: SparkSession, j: np.ndarray, c: np.ndarray, start: np.ndarray) -> DataFrame:
    """One row ``(bits, energy, gap)``: the best choice found from ``start`` on, and how much lower another could be at most."""
    energy = Energy(j, c)
    sent = spark.sparkContext.broadcast(energy)
    best, bits = energy.of(start), start.astype(int)
    n = len(c)
    cases = spark.createDataFrame([([-1] * n, float("-inf"))], "fixed array<int>, bound double")
    least = best
    for _ in range(ROUNDS):
        limit = best

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for fixed in batch["fixed"]:
                    found, choice, left = search(sent.value, np.array(fixed, int), limit, CASES)
                    rows = [(f.tolist(), b, None) for f, b in left]
                    if choice is not None:
                        rows.append((choice.astype(int).tolist(), None, found))
                    if rows:
                        yield pd.DataFrame(rows, columns=["fixed", "bound", "energy"]).astype({"bound": "float64", "energy": "float64"})

        spread = cases.repartition(4 * spark.sparkContext.defaultParallelism)
        seen = stage_table(spread.mapInPandas(look, "fixed array<int>, bound double, energy double"), "cases")
        top = seen.where(F.col("energy") > float("-inf")).orderBy("energy", "fixed").first()
        if top is not None and top["energy"] < best - EQUAL:
            best, bits = top["energy"], np.array(top["fixed"])
        cases = seen.where((F.col("bound") < best - EQUAL) & F.col("energy").isNull()).select("fixed", "bound")
        least = cases.agg(F.min("bound")).first()[0]
        if least is None:
            break
    gap = 0.0 if least is None else max(0.0, best - least)
    return spark.createDataFrame([([int(b) for b in bits], float(best), float(gap))], "bits array<int>, energy double, gap double")
