"""Vote products and bounded weights, summed in tasks and then by block.

Votes never leave the task that makes them.  A pass over the rows returns one of

* the products of all voters, in square blocks of the upper triangle, one set per task,
* H'(H w) for weights w, one number per learner,

and the parts of all tasks are added in two levels: first in some lots, then per block,
each task holding sums only.  No step needs more than one vector of learners and the
products of WORKING learners on the driver, however many learners there are.

Bounded weights minimise w'(H'H + penalty I)w - 2(H'y)'w over 0 <= w <= upper.  Each
round solves the problem of a working set of learners exactly, the others held still,
and a pass returns the slope of all learners at the new weights; the learners that
violate the conditions of optimality most come into the next set.  The energy falls in
every round, and the rounds end when no learner violates them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UPPER_BOUND = 1.0
SOLVE_STEPS = 20_000
SOLVE_TOLERANCE = 1e-7
NEWTON_STEPS = 200
#: Largest violation of the conditions of optimality that is left, and rounds until then at most.
ROUND_TOLERANCE, ROUNDS = 1e-6, 500
#: Learners whose weights one round changes: their products are collected (8 MB).
WORKING = 1024
#: Voters of a block's side, rows multiplied at once, lots of the first level of sums.
SIDE, ROWS, LOTS = 256, 2_000, 64
#: Numbers of blocks that a task holds; beyond, parts are handed on earlier.
HELD_CELLS = 1 << 25


@dataclass(frozen=True)
class Votes:
    """Rows, and how a task reads (votes x learners, signed labels) off a batch of them, a chunk at a time.

    ``read(batch, used)``: ``used`` are the learners wanted, None for all.
    """

    rows: DataFrame
    learners: int
    read: Callable[[pa.RecordBatch, np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray]]]


def _parts(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([np.ascontiguousarray(held[k], "<f8").tobytes() for k in keys], pa.binary())],
        ["bi", "bj", "data"],
    )


_BLOCKS = "bi int, bj int, data binary"


def add_blocks(parts: DataFrame) -> DataFrame:
    """``bi, bj, data``: the parts of each block added up, in two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "data"))):
                part = np.frombuffer(data, "<f8")
                held[i, j] = held[i, j] + part if (i, j) in held else part
        if held:
            yield _parts(held)

    lots = parts.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS)))
    some = lots.repartition("bi", "bj", "lot").select("bi", "bj", "data").mapInArrow(add, _BLOCKS)
    return some.repartition("bi", "bj").mapInArrow(add, _BLOCKS)


def product_blocks(votes: Votes, used: np.ndarray | None = None) -> DataFrame:
    """Blocks of the upper triangle of the summed products of all voters; the label is the last voter."""
    read = votes.read

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for h, y in read(batch, used):
                h = np.column_stack([h, y])
                sides = range(0, h.shape[1], SIDE)
                for bi, i in enumerate(sides):
                    for bj, j in enumerate(sides):
                        if bi <= bj:
                            part = (h[:, i : i + SIDE].T @ h[:, j : j + SIDE]).ravel()
                            held[bi, bj] = held[bi, bj] + part if (bi, bj) in held else part
                if len(held) * SIDE * SIDE > HELD_CELLS:
                    yield _parts(held)
                    held = {}
        if held:
            yield _parts(held)

    return add_blocks(votes.rows.mapInArrow(multiply, _BLOCKS))


def product_table(votes: Votes) -> DataFrame:
    """Long table ``(i, j, total)``, i <= j, of summed vote products."""
    voters = votes.learners + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "data"))):
                i, j = (np.arange(b * SIDE, min(voters, (b + 1) * SIDE)) for b in (bi, bj))
                total = np.frombuffer(data, "<f8").reshape(len(i), len(j))
                i, j = (x.ravel() for x in np.meshgrid(i, j, indexing="ij"))
                upper = i <= j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), pa.array(total.ravel()[upper])],
                    ["i", "j", "total"],
                )

    return product_blocks(votes).mapInArrow(cells, "i int, j int, total double")


def collected_products(votes: Votes, used: np.ndarray | None = None) -> np.ndarray:
    """The products of all voters, or of those used and the label, as one matrix."""
    voters = (votes.learners if used is None else len(used)) + 1
    full = np.zeros((voters, voters))
    for r in product_blocks(votes, used).collect():
        i, j = (slice(b * SIDE, min(voters, (b + 1) * SIDE)) for b in (r["bi"], r["bj"]))
        part = np.frombuffer(r["data"], "<f8").reshape(i.stop - i.start, j.stop - j.start)
        full[i, j] = part
        full[j, i] = part.T
    return full


def slope_sums(votes: Votes, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """H'(H w), H'y and the number of rows: one pass."""
    used = np.flatnonzero(w)
    some, read = w[used], votes.read

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for h, y in read(batch, None):
                raw = h[:, used] @ some
                part = np.concatenate([h.T @ raw, h.T @ y, [len(y)]])
                total = part if total is None else total + part
        if total is not None:
            yield _parts({(b, 0): total[at : at + SIDE * SIDE] for b, at in enumerate(range(0, len(total), SIDE * SIDE))})

    rows = add_blocks(votes.rows.mapInArrow(multiply, _BLOCKS)).collect()
    if not rows:
        return np.zeros(len(w)), np.zeros(len(w)), 0
    total = np.concatenate([np.frombuffer(r["data"], "<f8") for r in sorted(rows, key=lambda r: r["bi"])])
    n = len(w)
    return total[:n], total[n : 2 * n], int(total[-1])


def kkt_residual(j: np.ndarray, c: np.ndarray, w: np.ndarray, upper: float) -> float:
    """How far ``w`` is from optimal: 0 where the gradient pushes against the box."""
    gradient = 2.0 * (j @ w) + c
    return float(np.abs(w - np.clip(w - gradient / np.abs(j).max(), 0.0, upper)).max())


def solve_box(j: np.ndarray, c: np.ndarray, upper: float = UPPER_BOUND, start: np.ndarray | None = None) -> np.ndarray:
    """Minimise w'Jw + c'w over 0 <= w <= upper by accelerated projected steps.

    Starts at half the bound, or at ``start``; momentum restarts whenever it points uphill.
    """
    w = np.full(len(c), upper / 2.0) if start is None else start.copy()
    step = 1.0 / (2.0 * max(float(np.linalg.eigvalsh(j)[-1]), 1e-12))
    ahead, t = w.copy(), 1.0
    for _ in range(SOLVE_STEPS):
        moved = np.clip(ahead - step * (2.0 * (j @ ahead) + c), 0.0, upper)
        if np.dot(ahead - moved, moved - w) > 0:
            t = 1.0
        after = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        ahead = moved + (t - 1.0) / after * (moved - w)
        w, t = moved, after
        if (left := kkt_residual(j, c, w, upper)) <= SOLVE_TOLERANCE:
            return w
    raise ArithmeticError(f"no weights found in {SOLVE_STEPS} steps: the residual is {left:g}")


def newton_box(j: np.ndarray, c: np.ndarray, start: np.ndarray, upper: float = UPPER_BOUND) -> np.ndarray:
    """The same minimum by projected Newton steps over the weights that no bound holds; ends early when they stop helping."""
    w, scale = start.copy(), max(float(np.abs(j).max()), 1e-12)
    value = float(w @ j @ w + c @ w)
    for _ in range(NEWTON_STEPS):
        slope = 2.0 * (j @ w) + c
        if np.abs(w - np.clip(w - slope / scale, 0.0, upper)).max() <= SOLVE_TOLERANCE:
            break
        free = np.flatnonzero(~((w <= 0.0) & (slope > 0) | (w >= upper) & (slope < 0)))
        move = np.zeros(len(w))
        move[free] = -np.linalg.solve(2.0 * j[np.ix_(free, free)] + 1e-9 * scale * np.eye(len(free)), slope[free])
        share = 1.0
        while share > 1e-6:
            tried = np.clip(w + share * move, 0.0, upper)
            found = float(tried @ j @ tried + c @ tried)
            if found < value - 1e-15 * abs(value):
                break
            share /= 2.0
        else:
            break
        w, value = tried, found
    return w


def bounded_weights(votes: Votes, penalty: float = 0.0, upper: float = UPPER_BOUND) -> tuple[np.ndarray, np.ndarray]:
    """The weights, and how far each learner is from the conditions of optimality."""
    w = np.zeros(votes.learners)
    known, products = np.empty(0, np.int64), np.empty((0, 0))
    product, agreement, rows = slope_sums(votes, w)
    scale = max(rows + penalty, 1e-12)  # the diagonal of H'H + penalty I, its largest entry
    for _ in range(ROUNDS):
        slope = 2.0 * (product + penalty * w) - 2.0 * agreement
        residual = np.abs(w - np.clip(w - slope / scale, 0.0, upper))
        if residual.max(initial=0.0) <= ROUND_TOLERANCE:
            return w, residual
        # the worst first, then weights inside the box, then the likeliest to move
        order = np.lexsort((slope, -((w > 0) & (w < upper)).astype(int), -np.where(residual > ROUND_TOLERANCE, residual, 0.0)))
        some = np.sort(order[:WORKING])
        if not np.isin(some, known).all():
            known, products = some, collected_products(votes, some)[:-1, :-1]
        at = np.searchsorted(known, some)
        j = products[np.ix_(at, at)] + penalty * np.eye(len(some))
        own = slope[some] - 2.0 * (j @ w[some])
        found = newton_box(j, own, w[some], upper)
        w[some] = found if kkt_residual(j, own, found, upper) <= SOLVE_TOLERANCE else solve_box(j, own, upper, found)
        product = slope_sums(votes, w)[0]
    raise ArithmeticError(f"no weights found in {ROUNDS} rounds: the residual is {residual.max():g}")
