"""Exact nearest-neighbour join.

Rows to search are grouped around pivots.  A query row first looks in the cell
of its own pivot; the k-th distance found there bounds the answer, and by the
triangle inequality only cells that can hold something closer are visited after
that.  Inside a task the rows of a block lie in small boxes, and of few features only
boxes within reach are compared; of many features a sieve over all rows leaves
few to be measured exactly.  Large cells are cut into blocks by key digest, and the query rows visiting
a cell are cut into slices, so a task compares one slice with one block whatever
the skew, and emits one list of k per query row, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rarelane.functions.text import double
from rarelane.session import stage_table

# Rows of one block of the searched side and of one slice of query rows, of many features.
BLOCK_ROWS = 20_000
# Pivots are collected to the driver and sent to the tasks: at most this many.
MAX_PIVOTS = 2_048
# Numbers in the table of inner distances (views x pivots x k), sent to the tasks.
MAX_SUMMARY = 4_000_000
# Values of a line answered at a time.
ROUTED_ROWS = 20_000
# Rows of a box inside a task, and the most features by which boxes can leave rows out.
BOX_ROWS, BOX_WIDTH = 64, 16
# Distances held at a time: small enough to stay in the processor's cache.
CHUNK_CELLS = 60_000
# Rows asked (of matrix products, of whole numbers) and rows searched that a sieve compares at a time; pairs then measured at a time.
PRODUCT_ROWS, WHOLE_ROWS, SIEVE_COLUMNS = 128, 32, 8_192
EXACT_PAIRS = 4_096
# Whole numbers of a sieve for p = 1 and infinity, up to so many steps, and how many gaps of p = 1 one byte holds the sum of.
STEPS, GAPS_A_BYTE = {1.0: 31, math.inf: 63}, 4
# A sieve that leaves more than this share of the pairs is not worth its time.
SIEVE_SHARE = 1 / 8
# Up to this many row pairs, comparing all of them is cheaper than making cells.
ONE_CELL_PAIRS = 1_000_000_000
# Values of one part of a line, and the most parts; their ends are collected.
LINE_ROWS, MAX_PARTS = 50_000, 4_096
# Row pairs one comparing task should look at, and the most tasks of that stage.
WORK_PER_TASK = 1_000_000_000
MAX_TASKS = 100_000
# Groups of a slice and a block wanted per core: a core that gets several of them by chance then waits little.
GROUPS_PER_CORE = 4


# What is wanted of a list of neighbours, as an expression of it.
Fold = Callable[[Column], Column]


@dataclass(frozen=True)
class Metric:
    """Minkowski distance of order ``p``; infinity is Chebyshev."""

    p: float = 2.0

    @staticmethod
    def named(name: str, p: float = 2.0) -> Metric:
        orders = {"minkowski": p, "euclidean": 2.0, "manhattan": 1.0, "chebyshev": math.inf}
        if name not in orders:
            raise ValueError(f"unknown distance {name!r}: expected one of {sorted(orders)}")
        if orders[name] < 1:
            raise ValueError("the order p must be at least 1")
        return Metric(float(orders[name]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All distances between the rows of ``a`` and the rows of ``b``."""
        total = np.zeros((len(a), len(b)))
        gap = np.empty_like(total)
        for j in range(a.shape[1]):
            np.subtract(a[:, j, None], np.ascontiguousarray(b[:, j])[None], out=gap)
            if self.p == 2:
                np.multiply(gap, gap, out=gap)
                np.add(total, gap, out=total)
                continue
            np.abs(gap, out=gap)
            if math.isinf(self.p):
                np.maximum(total, gap, out=total)
                continue
            if self.p != 1:
                np.power(gap, self.p, out=gap)
            np.add(total, gap, out=total)
        return self._rooted(total)

    def along(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the rows of ``a`` from the same rows of ``b``, digit by digit those of ``between``."""
        total = np.zeros(len(a))
        for j in range(a.shape[1]):
            gap = a[:, j] - b[:, j]
            if self.p == 2:
                total += gap * gap
            elif math.isinf(self.p):
                np.maximum(total, np.abs(gap), out=total)
            else:
                total += np.abs(gap) if self.p == 1 else np.power(np.abs(gap), self.p)
        return self._rooted(total)

    @property
    def has_coarse(self) -> bool:
        return self.p in (1.0, 2.0, 3.0) or math.isinf(self.p)

    def coarse(self, a: np.ndarray, columns: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Distances to the power p (p = inf: 1) in single precision, of numbers between -1 and 1.

        The other rows come as ``columns``, one line per feature, with the sums of their ``squares``: made
        once for all rows asked, as turning a block costs as much as comparing it with some rows.
        """
        if self.p == 2:
            return np.maximum((a * a).sum(axis=1)[:, None] + squares[None] - 2.0 * (a @ columns), 0.0)
        total = np.zeros((len(a), columns.shape[1]), np.float32)
        gap = np.empty_like(total)
        cube = np.empty_like(total) if self.p == 3 else None
        for j, column in enumerate(columns):
            np.subtract(a[:, j, None], column[None], out=gap)
            np.abs(gap, out=gap)
            if math.isinf(self.p):
                np.maximum(total, gap, out=total)
                continue
            if self.p == 3:
                np.multiply(gap, gap, out=cube)
                np.multiply(gap, cube, out=gap)
            np.add(total, gap, out=total)
        return total

    def coarse_limit(self, powers: np.ndarray, width: int) -> np.ndarray:
        """What ``coarse`` can give at most for rows within the distances that it gave as ``powers``.

        A gap is off by less than 2^-21, a sum by a share of less than (width + 8) 2^-22; for p = 2 the
        terms of the square are off by less than (width + 8) 2^-20 in all.
        """
        if self.p == 2:
            return powers + width * (width + 8) * 2.0**-19
        order = 1.0 if math.isinf(self.p) else self.p
        share, off = (width + 8) * 2.0**-22, 2.0**-21 * (1.0 if math.isinf(self.p) else width ** (1.0 / self.p))
        return (np.power(powers * (1.0 + share), 1.0 / order) + 2.0 * off) ** order / (1.0 - share)

    def _rooted(self, total: np.ndarray) -> np.ndarray:
        if self.p == 2:
            return np.sqrt(total, out=total)
        if self.p == 1 or math.isinf(self.p):
            return total
        return np.power(total, 1.0 / self.p, out=total)


def _chunks(rows: int, other: int) -> Iterator[slice]:
    step = max(1, CHUNK_CELLS // max(other, 1))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def _closest(distance: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest entries per row; ties go to the left.

    The k-th smallest minimum over blocks of columns bounds the k-th entry, so
    only the few entries within it are sorted.
    """
    rows, columns = distance.shape
    block = columns // (8 * k)
    if block < 2:
        return np.argsort(distance, axis=1, kind="stable")[:, :k]
    minima = distance[:, : columns // block * block].reshape(rows, -1, block).min(axis=2)
    bound = np.partition(minima, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(distance <= bound)
    order = np.lexsort((column, distance[row, column], row))
    first = np.searchsorted(row, np.arange(rows))
    return column[order][first[:, None] + np.arange(k)]


def _closest_on_line(
    asks: np.ndarray, values: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Single feature: 2k candidates per value asked, by sorted search.

    ``values`` come in key order.  The k next ones to the right (equal values by
    rising key) and to the left (likewise, walking down) hold the k nearest.
    Returns candidate numbers (-1 where there is none) and their distances.
    """
    up = np.lexsort((np.arange(len(values)), values))
    down = np.lexsort((-np.arange(len(values)), values))
    spot = np.searchsorted(values[up], asks, side="left")
    steps = np.arange(k)
    right, left = spot[:, None] + steps, spot[:, None] - 1 - steps
    picked = np.concatenate(
        [
            np.where(right < len(values), up[np.minimum(right, len(values) - 1)], -1),
            np.where(left >= 0, down[np.maximum(left, 0)], -1),
        ],
        axis=1,
    )
    distance = np.where(picked >= 0, np.abs(asks[:, None] - values[picked]), np.inf)
    return picked, distance


def _k_nearest(
    asks: np.ndarray, holds: np.ndarray, own: np.ndarray, k: int, metric: Metric
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``holds`` and distances of the k nearest, per row asked.

    ``own`` is the row to leave out for each row asked, or -1.  Ties go to the
    lower row number.
    """
    distance = metric.between(asks, holds)
    mine = np.nonzero(own >= 0)[0]
    distance[mine, own[mine]] = np.inf
    cand = _closest(distance, k)
    return cand, np.take_along_axis(distance, cand, 1)


class _Sieve:
    """Tells quickly which of many rows can lie within reach of a row: it may name too many, never too few.

    p = 2 and 3: a matrix product gives Euclidean distances, and one of order 3 is at least width^(-1/6) of them;
    what is left of order 3 is then cubed in single precision.
    p = 1 and infinity: numbers are cut off far out, which brings no two rows apart, and rounded to steps that
    a byte holds; a distance of the whole numbers is off by what the rounding moved the rows.
    """

    def __init__(self, asks: np.ndarray, holds: np.ndarray, metric: Metric):
        self.p, self.width, self.metric = metric.p, holds.shape[1], metric
        self.product = self.p in (2.0, 3.0)
        self.rows_at_a_time = PRODUCT_ROWS if self.product else WHOLE_ROWS
        middle = holds.mean(axis=0)
        a, b = asks - middle, holds - middle
        top = max(np.abs(a).max(initial=0.0), np.abs(b).max()) or 1.0
        if self.product:
            self.top = top
            a, b = (a / top).astype(np.float32), (b / top).astype(np.float32)
            self.plain = a, b
            self.squares = (a * a).sum(axis=1)
            # the product with this further column is a.b - b.b / 2, which falls as the distance rises
            self.asks = np.column_stack([a, np.ones(len(a), np.float32)])
            b = np.column_stack([b, (b * b).sum(axis=1) / np.float32(-2.0)])
        else:
            top = min(top, 3.0 * float(np.sqrt((b * b).mean())) or top)
            self.step = top / STEPS[self.p]
            moved = []
            for x in (a, b):
                np.clip(x, -top, top, out=x)
                rest = np.abs(x - np.rint(x / self.step) * self.step)
                moved.append(rest.max(axis=1) if math.isinf(self.p) else rest.sum(axis=1))
            self.moved = moved[0] + moved[1].max()
            self.asks, b = np.rint(a / self.step).astype(np.int8), np.rint(b / self.step).astype(np.int8)
        self.columns = np.ascontiguousarray(b.T)

    @staticmethod
    def suits(metric: Metric, width: int) -> bool:
        return metric.p in (1.0, 2.0, 3.0, math.inf) and width <= 1_024

    def measure(self, part: slice, some: slice) -> np.ndarray:
        """A number per pair that rises with the distance (products: falls)."""
        a, b = self.asks[part], self.columns[:, some]
        if self.product:
            return a @ b
        gap, some = np.empty((2, len(a), b.shape[1]), np.int8)
        total = np.zeros(gap.shape, np.uint16 if self.p == 1 else np.uint8)
        for j, column in enumerate(b):
            first = self.p == 1 and j % GAPS_A_BYTE == 0
            np.subtract(a[:, j, None], column[None], out=gap)
            np.abs(gap, out=some if first else gap)
            if self.p != 1:
                np.maximum(total, gap.view(np.uint8), out=total)
                continue
            if not first:
                np.add(some.view(np.uint8), gap.view(np.uint8), out=some.view(np.uint8))
            if j % GAPS_A_BYTE == GAPS_A_BYTE - 1 or j == self.width - 1:
                np.add(total, some.view(np.uint8), out=total)
        return total

    def limit(self, part: slice, reach: np.ndarray) -> np.ndarray:
        """The last ``measure`` that rows within ``reach`` of the rows asked can have."""
        if self.product:
            within = (reach / self.top) ** 2 * (self.width ** (1.0 / 3.0) if self.p == 3 else 1.0)
            within = within * (1.0 + 1e-6) + self.width * (self.width + 8) * 2.0**-19
            return ((self.squares[part] - within) / 2.0).astype(np.float32)
        steps = np.floor((reach + self.moved[part]) / self.step * (1.0 + 1e-9) + 1e-6)
        kind = np.uint16 if self.p == 1 else np.uint8
        return np.minimum(steps, np.iinfo(kind).max).astype(kind)

    def within(self, part: slice, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``part``, rows searched) of the pairs that can lie within reach, if they are few; else all rows searched."""
        limit, rows, columns = self.limit(part, reach)[:, None], [], []
        count, left = self.columns.shape[1], SIEVE_SHARE * len(reach) * self.columns.shape[1]
        for at in range(0, count, SIEVE_COLUMNS):
            measured = self.measure(part, slice(at, at + SIEVE_COLUMNS))
            near = measured >= limit if self.product else measured <= limit
            bits = np.packbits(near.ravel())
            some = np.flatnonzero(bits)
            left -= int(np.bitwise_count(bits[some]).sum())
            if left < 0:
                raise _TooMany
            spot, bit = np.nonzero(np.unpackbits(bits[some]).reshape(-1, 8))
            row, column = np.divmod(some[spot] * 8 + bit, near.shape[1])
            column += at
            if self.p == 3:
                row, column = self._cubed(part, reach, row, column)
            rows.append(row)
            columns.append(column)
        return np.concatenate(rows), np.concatenate(columns)

    def _cubed(self, part: slice, reach: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that cubes in single precision leave."""
        a, b = self.plain[0][part], self.plain[1]
        most = self.metric.coarse_limit((reach / self.top) ** 3, self.width).astype(np.float32) * np.float32(1.0 + 1e-6)
        kept = np.empty(len(row), bool)
        for at in range(0, len(row), EXACT_PAIRS):
            some = slice(at, at + EXACT_PAIRS)
            kept[some] = self._cubes(a, row[some], b, column[some]) <= most[row[some]]
        return row[kept], column[kept]

    @staticmethod
    def _cubes(a: np.ndarray, row: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
        gap = a.take(row, axis=0)
        gap -= b.take(column, axis=0)
        np.abs(gap, out=gap)
        return np.einsum("ij,ij->i", gap * gap, gap)

    def nearly(self, part: slice, own: np.ndarray, k: int) -> np.ndarray:
        """Numbers of k rows that lie near each row asked, its own not among them."""
        size = min(self.columns.shape[1], max(SIEVE_COLUMNS, 16 * k))
        measured = self.measure(part, slice(0, size))
        if self.product:
            measured = -measured
        mine = np.flatnonzero((own >= 0) & (own < size))
        measured[mine, own[mine]] = np.inf if self.product else np.iinfo(measured.dtype).max
        block = size // (8 * k)
        blocks = measured[:, : size // block * block].reshape(len(measured), -1, block)
        least = blocks.argmin(axis=2)
        low = np.take_along_axis(blocks, least[:, :, None], 2)[:, :, 0]
        if self.p == 3:
            every = (least + np.arange(blocks.shape[1]) * block).ravel()
            rows = np.repeat(np.arange(len(low)), blocks.shape[1])
            low = np.where(np.isinf(low), low, self._cubes(self.plain[0][part], rows, self.plain[1], every).reshape(low.shape))
        picked = np.argpartition(low, k, axis=1)[:, : k + 1]
        found = picked * block + np.take_along_axis(least, picked, 1)
        # of k + 1 rows the own one goes, or the last
        found = np.take_along_axis(found, np.argsort(found == own[:, None], axis=1, kind="stable"), 1)
        return found[:, :k]


class _TooMany(Exception):
    """A sieve leaves too many pairs."""


def _measured(metric: Metric, a: np.ndarray, rows: np.ndarray, b: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of the pairs (rows of ``a``, rows of ``b``), some pairs at a time."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), EXACT_PAIRS):
        part = slice(at, at + EXACT_PAIRS)
        out[part] = metric.along(a.take(rows[part], axis=0), b.take(columns[part], axis=0))
    return out


def _all_nearest(
    asks: np.ndarray, holds: np.ndarray, own: np.ndarray, k: int, metric: Metric, bound: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows asked, ``_k_nearest`` of them), comparing all; finite numbers only.

    Of many features a sieve tells first which few rows can be among the k nearest, and within ``bound``; places
    left over then hold an infinite distance.
    """
    width, block = holds.shape[1], len(holds) // (8 * k)
    if width <= BOX_WIDTH or block < 2 or not metric.has_coarse:
        for part in _chunks(len(asks), len(holds)):
            yield np.arange(len(asks))[part], *_k_nearest(asks[part], holds, own[part], k, metric)
        return
    bound = np.full(len(asks), np.inf) if bound is None else bound
    if not _Sieve.suits(metric, width):
        yield from _coarse_nearest(asks, holds, own, k, metric)
        return
    sieve, coarse = _Sieve(asks, holds, metric), []
    for start in range(0, len(asks), sieve.rows_at_a_time):
        part = slice(start, start + sieve.rows_at_a_time)
        rows, mine, reach = np.arange(len(asks))[part], own[part], bound[part].copy()
        open_rows = np.flatnonzero(~np.isfinite(reach))
        if len(open_rows):
            some = sieve.nearly(part, mine, k)[open_rows]
            away = _measured(metric, asks, np.repeat(rows[open_rows], k), holds, some.ravel())
            reach[open_rows] = away.reshape(-1, k).max(axis=1)
        try:
            row, column = sieve.within(part, reach)
        except _TooMany:
            coarse.append(rows)
            continue
        other = column != mine[row]
        row, column = row[other], column[other]
        distance = _measured(metric, asks, rows[row], holds, column)
        near = distance <= reach[row]
        yield rows, *_first_of_each(row[near], column[near], distance[near], len(rows), k)
    if coarse:
        rest = np.concatenate(coarse)
        for rows, picked, near in _coarse_nearest(asks[rest], holds, own[rest], k, metric):
            yield rest[rows], picked, near


def _first_of_each(
    row: np.ndarray, column: np.ndarray, distance: np.ndarray, rows: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the pairs of each row: numbers and distances, infinite where there are fewer."""
    order = np.lexsort((column, distance, row))
    row, column, distance = row[order], column[order], distance[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    picked, near = np.zeros((rows, k), np.int64), np.full((rows, k), np.inf)
    picked[row[kept], rank[kept]], near[row[kept], rank[kept]] = column[kept], distance[kept]
    return picked, near


def _coarse_nearest(
    asks: np.ndarray, holds: np.ndarray, own: np.ndarray, k: int, metric: Metric
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_all_nearest`` by single precision distances of all pairs, which leave few rows whatever the numbers."""
    width, block = holds.shape[1], len(holds) // (8 * k)
    middle = holds.mean(axis=0)
    a, b = asks - middle, holds - middle
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max()) or 1.0
    a, b = (a / top).astype(np.float32), (b / top).astype(np.float32)
    columns, squares = np.ascontiguousarray(b.T), (b * b).sum(axis=1)
    for part in _chunks(len(asks), len(holds)):
        rows = np.arange(len(asks))[part]
        rough = metric.coarse(a[part], columns, squares)
        mine = np.nonzero(own[part] >= 0)[0]
        rough[mine, own[part][mine]] = np.inf
        minima = rough[:, : len(holds) // block * block].reshape(len(rows), -1, block).min(axis=2)
        kth = np.partition(minima, k - 1, axis=1)[:, k - 1].astype(float)
        row, column = np.nonzero(rough <= metric.coarse_limit(kth, width)[:, None])
        distance = _measured(metric, asks, rows[row], holds, column)
        order = np.lexsort((column, distance, row))
        first = np.searchsorted(row, np.arange(len(rows)))[:, None] + np.arange(k)
        yield rows, column[order][first], distance[order][first]


def _boxes(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in boxes of at most ``most`` points, halved along the widest feature."""
    out, left = [], [np.arange(len(points))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = points[rows]
        half = len(rows) // 2
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)
        left += [rows[order[half:]], rows[order[:half]]]
    return out


def _within_reach(
    asks: np.ndarray, holds: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, metric: Metric
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows asked, numbers in ``holds``, distances): up to k nearest, all of those within ``bound`` among them.

    Rows asked that lie together look only in the boxes as near as the k-th row of the nearest boxes.
    """
    if not len(holds) or not len(asks):
        return
    if holds.shape[1] > BOX_WIDTH or len(holds) <= 4 * BOX_ROWS:
        yield from _all_nearest(asks, holds, own, k, metric, bound)
        return
    boxes = _boxes(holds, BOX_ROWS)
    low = np.stack([holds[r].min(axis=0) for r in boxes])
    high = np.stack([holds[r].max(axis=0) for r in boxes])
    sizes = np.array([len(r) for r in boxes])
    origin = np.zeros((1, holds.shape[1]))
    for rows in _boxes(asks, min(BOX_ROWS, max(8, BOX_ROWS * len(asks) // len(holds)))):
        mine, reach = asks[rows], bound[rows].astype(float)
        apart = np.maximum(np.maximum(low - mine.max(axis=0), mine.min(axis=0) - high), 0.0)
        least = metric.between(apart, origin)[:, 0]
        if not np.isfinite(reach).all():
            order = np.argsort(least, kind="stable")
            enough = np.searchsorted(np.cumsum(sizes[order]), k + 1) + 1
            some = np.concatenate([boxes[i] for i in order[:enough]])
            near = metric.between(mine, holds[some])
            near[some[None] == own[rows][:, None]] = np.inf
            if len(some) >= k:
                reach = np.minimum(reach, np.partition(near, k - 1, axis=1)[:, k - 1])
        open_boxes = np.flatnonzero(least <= reach.max() * (1.0 + 1e-9))
        if len(open_boxes) > 4:
            sides = np.maximum(low[open_boxes][None] - mine[:, None], mine[:, None] - high[open_boxes][None])
            own_least = metric.between(np.maximum(sides, 0.0).reshape(-1, holds.shape[1]), origin).reshape(len(mine), -1)
            open_boxes = open_boxes[(own_least <= reach[:, None] * (1.0 + 1e-9)).any(axis=0)]
        if not len(open_boxes):
            continue
        some = np.sort(np.concatenate([boxes[i] for i in open_boxes]))
        at = np.minimum(np.searchsorted(some, own[rows]), len(some) - 1)
        at = np.where(some[at] == own[rows], at, -1)
        for part in _chunks(len(rows), len(some)):
            picked, near = _k_nearest(mine[part], holds[some], at[part], k, metric)
            yield rows[part], some[picked], near


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix; a missing number is NaN."""
    if not len(column):
        return np.zeros((0, 0))
    return _whole(column).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


@dataclass(frozen=True)
class Cells:
    """Per view, pivots with each cell's radius and k smallest member distances.

    A view is a subset of the features; ``columns`` holds the positions.
    """

    pivots: np.ndarray
    columns: list[list[int]]
    radius: np.ndarray
    inner: np.ndarray

    @property
    def per_view(self) -> int:
        return len(self.pivots)


def _by_view(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(view, row positions, vectors) for each view in the batch."""
    views, vectors = batch.column("view").to_numpy(), batch.column("vector")
    for view in np.unique(views):
        rows = np.flatnonzero(views == view)
        yield int(view), rows, _vectors(vectors if len(rows) == len(views) else vectors.take(pa.array(rows)))


def _assign_cells(
    base: DataFrame, pivots: np.ndarray, columns: list[list[int]], metric: Metric
) -> DataFrame:
    """Add the nearest pivot's cell number and the distance to the pivot."""
    if len(pivots) == 1:
        return base.withColumn("cell", F.col("view")).withColumn("away", F.lit(0.0))
    shared = base.sparkSession.sparkContext.broadcast((pivots, columns))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, columns = shared.value
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            away = np.zeros(batch.num_rows)
            for view, rows, points in _by_view(batch):
                centres = pivots[:, columns[view]]
                for part in _chunks(len(points), len(centres)):
                    d = metric.between(points[part], centres)
                    near = d.argmin(axis=1)
                    cell[rows[part]] = view * len(pivots) + near
                    away[rows[part]] = d[np.arange(len(d)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    schema = T.StructType(
        [*base.schema, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    )
    return base.mapInArrow(place, schema)


def _summarise_cells(
    placed: DataFrame, pivots: np.ndarray, columns: list[list[int]], k: int
) -> Cells:
    """Radius and k smallest member distances: at most k rows per view and pivot."""
    order = Window.partitionBy("cell").orderBy("away", "key")
    near = (
        placed.select("cell", "away", "key")
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= k)
        .select("cell", "r", "away")
        .toPandas()
    )
    far = placed.groupBy("cell").agg(F.max("away").alias("away")).toPandas()
    cells = len(pivots) * len(columns)
    radius = np.full(cells, -np.inf)
    radius[far["cell"].to_numpy()] = far["away"].to_numpy()
    inner = np.full((cells, k), np.inf)
    inner[near["cell"].to_numpy(), near["r"].to_numpy() - 1] = near["away"].to_numpy()
    return Cells(pivots, columns, radius, inner)


def _visits(first: DataFrame, cells: Cells, k: int, metric: Metric) -> DataFrame:
    """Add ``visits``: the other cells that may hold something closer; ``bound`` then is how near that must be.

    ``first`` has the query rows with their home ``cell`` and ``bound``, the
    k-th distance found there (NULL when the cell holds too few rows; then the
    members nearest to the pivots give a bound).  A row x of cell c, with pivot
    distances d_c and d_home of the query row, is at least d_c - radius away,
    at least (d_c - d_home) / 2, and, in Euclidean space, at least as far as
    the plane midway between the two pivots.
    """
    shared = first.sparkSession.sparkContext.broadcast(
        (cells.pivots, cells.columns, cells.radius, cells.inner)
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, columns, radius, inner = shared.value
        p = len(pivots)
        between: dict[int, np.ndarray] = {}
        for batch in batches:
            found = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            home = batch.column("cell").to_numpy()
            limits, counts, rows_open, cells_open = found.copy(), np.zeros(len(found) + 1, np.int64), [], []
            for view, rows, points in _by_view(batch):
                centres = pivots[:, columns[view]]
                if view not in between:
                    between[view] = metric.between(centres, centres) if metric.p == 2 else np.empty(0)
                apart = between[view]
                mine = slice(view * p, view * p + p)
                for part in _chunks(len(points), p):
                    at = rows[part]
                    d = metric.between(points[part], centres)
                    bound, own = found[at].copy(), home[at] - view * p
                    for short in np.nonzero(np.isnan(bound))[0]:
                        reach = (d[short][:, None] + inner[mine]).ravel()
                        bound[short] = np.partition(reach, k - 1)[k - 1]
                    near = d[np.arange(len(d)), own][:, None]
                    least = np.maximum(d - radius[mine][None], (d - near) / 2.0)
                    if metric.p == 2:
                        gap = 2.0 * apart[own]
                        plane = (d * d - near * near) / np.where(gap > 0, gap, np.inf)
                        least = np.maximum(least, plane)
                    slack = 1e-9 * (1.0 + d.max(axis=1))
                    limit = np.where(np.isfinite(bound), bound + slack, np.inf)
                    open_cells = (least <= limit[:, None]) & np.isfinite(radius[mine])[None]
                    open_cells[np.arange(len(d)), own] = False
                    row, cell = np.nonzero(open_cells)
                    limits[at] = limit
                    counts[at + 1] = open_cells.sum(axis=1)
                    rows_open.append(at[row])
                    cells_open.append(view * p + cell)
            order = np.argsort(_joined(rows_open, np.int64), kind="stable")
            every = pa.array(_joined(cells_open, np.int32)[order])
            visits = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), every)
            out = dict(zip(batch.schema.names, batch.columns)) | {"bound": pa.array(limits), "visits": visits}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return first.mapInArrow(visit, T.StructType([*first.schema, T.StructField("visits", T.ArrayType(T.IntegerType()))]))


def nearest(
    query: DataFrame,
    base: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    metric: Metric = Metric(),
    **options,
) -> DataFrame:
    """The k nearest rows of ``base`` for each row of ``query``, one row each.

    Returns ``key, rank, distance, base_key`` plus the ``carry`` columns of the
    base row.  Options are those of ``nearest_lists``.
    """
    lists = nearest_lists(query, base, key, [features], k, metric, **options)
    long = lists.select(key, F.posexplode("near").alias("pos", "one"))
    return long.select(key, (F.col("pos") + 1).alias("rank"), "one.*")


def _long(df: DataFrame, key: str, views: Sequence[Sequence[str]], carry: Sequence[str]):
    """One row per view and row: ``view, key, vector`` and the carried columns."""
    vectors = [f"array({', '.join(map(double, view))})" for view in views]
    if len(views) == 1:
        return df.select(
            F.lit(0).alias("view"), F.col(key).alias("key"), F.expr(vectors[0]).alias("vector"),
            *carry,
        )
    cells = ", ".join(f"named_struct('view', {i}, 'vector', {v})" for i, v in enumerate(vectors))
    return df.select(F.col(key).alias("key"), F.expr(f"inline(array({cells}))"), *carry).select(
        "view", "key", "vector", *carry
    )


def _on_lines(df: DataFrame, key: str, features: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``view, key, value`` and the carried columns, a row per line (feature) and row."""
    cells = ", ".join(f"named_struct('view', {i}, 'value', {double(f)})" for i, f in enumerate(features))
    return df.select(F.col(key).alias("key"), F.expr(f"inline(array({cells}))"), *carry).select(
        "view", "key", "value", *carry
    )


def nearest_on_lines(
    query: DataFrame,
    base: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    carry: Sequence[str] = (),
    skip_self: bool = False,
    with_vectors: bool = False,
    fold: Fold | None = None,
) -> DataFrame:
    """``nearest_lists`` of single features: neighbours on a sorted line, without pairs.

    Each distinct value is answered once.  Lines are cut into parts of about LINE_ROWS
    values; a part also gets the k rows next to it on either side, wherever they lie, so
    it answers its values alone.  Of equal base values the k lowest keys are kept.
    A query row without a value has an empty list.
    """
    k_plus = k + skip_self
    known = F.col("value").isNotNull() & ~F.isnan("value")
    ask = _on_lines(query, key, features, [])
    hold = _on_lines(base, key, features, carry).where(known)
    copies = Window.partitionBy("view", "value").orderBy("key")
    hold = hold.withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= k_plus).drop("__n")
    hold = stage_table(hold, "line")
    values = stage_table(ask.where(known).select("view", "value").distinct(), "values")
    cuts = _line_cuts(hold.select("view", "value").unionByName(values), len(features))
    hold, values = stage_table(_in_parts(hold, cuts), "line_parts"), _in_parts(values, cuts)
    near = hold.unionByName(_halo(hold, k_plus, max(map(len, cuts)))).groupBy("view", "part").cogroup(values.groupBy("view", "part"))
    kind = base.schema[key].dataType
    fields = [
        T.StructField("view", T.IntegerType()), T.StructField("value", T.DoubleType()),
        T.StructField("distance", T.ArrayType(T.DoubleType())), T.StructField("base_key", T.ArrayType(kind)),
        *[T.StructField(c, T.ArrayType(base.schema[c].dataType)) for c in carry],
    ]
    lists = ["distance", "base_key", *carry]
    if with_vectors:
        fields.append(T.StructField("base_vector", T.ArrayType(T.ArrayType(T.DoubleType()))))
        lists.append("base_vector")
    found = near.applyInArrow(_line_kernel(k_plus, [f.name for f in fields], tuple(carry)), T.StructType(fields))
    packed = found.select("view", "value", F.arrays_zip(*lists).alias("near"))
    none = F.array().cast(packed.schema["near"].dataType)
    early = fold if fold and not skip_self else lambda near: near
    packed = packed.select("view", "value", early(F.col("near")).alias("near"), F.lit(True).alias("known"))
    packed = stage_table(packed, "line_lists")
    joined = ask.join(packed, ["view", "value"], "left")
    kept = F.when(F.col("known"), F.col("near")).otherwise(early(none))
    if early is not fold:
        if skip_self:
            kept = F.filter(kept, lambda x: x["base_key"] != F.col("key"))
        kept = F.slice(kept, 1, k)
        kept = fold(kept) if fold else kept
    return joined.select("view", F.col("key").alias(key), kept.alias("near"))


def _line_cuts(values: DataFrame, views: int) -> list[np.ndarray]:
    """Per line the inner ends of its parts: at most MAX_PARTS values of each."""
    counts = {r["view"]: r["count"] for r in values.groupBy("view").count().collect()}
    parts = min(MAX_PARTS, -(-max(counts.values(), default=0) // LINE_ROWS))
    if parts < 2:
        return [np.empty(0)] * views
    ends = F.percentile_approx("value", [i / parts for i in range(1, parts)], 100 * parts).alias("ends")
    found = {r["view"]: np.unique(r["ends"]) for r in values.groupBy("view").agg(ends).collect()}
    return [found.get(v, np.empty(0)) for v in range(views)]


def _in_parts(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Add ``part``: how many ends lie below the value."""
    if not any(map(len, cuts)):
        return rows.withColumn("part", F.lit(0))
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.zeros(len(batch), np.int32)
            view, value = batch["view"].to_numpy(), batch["value"].to_numpy(dtype=float)
            for v in np.unique(view):
                own = view == v
                part[own] = np.searchsorted(sent.value[v], value[own])
            yield batch.assign(part=part)

    return rows.mapInPandas(place, T.StructType([*rows.schema, T.StructField("part", T.IntegerType())]))


def _halo(hold: DataFrame, k: int, top: int) -> DataFrame:
    """Rows of other parts that a part, up to number ``top``, needs: the k next to it on either side.

    Only the outermost k rows of the parts can be such rows: 2k per part at most.
    """
    own = Window.partitionBy("view", "part")
    first = F.row_number().over(own.orderBy("value", "key"))
    last = F.row_number().over(own.orderBy(F.desc("value"), "key"))
    low = hold.withColumn("__n", first).where(F.col("__n") <= k).drop("__n").withColumn("low", F.lit(True))
    high = hold.withColumn("__n", last).where(F.col("__n") <= k).drop("__n").withColumn("low", F.lit(False))
    ends = stage_table(low.unionByName(high), "ends")

    columns = [f.name for f in hold.schema]

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        return around_rows(rows, top, k, columns)

    return ends.groupBy("view").applyInPandas(made, hold.schema)


def around_rows(ends: pd.DataFrame, top: int, k: int, columns: list[str]) -> pd.DataFrame:
    """For each part of a line up to ``top``, the k ``ends`` next to it on either side."""
    out = []
    for low in (True, False):
        side = ends[ends["low"] == low].sort_values(["value", "key"], ascending=[low, True], ignore_index=True)
        part = side["part"].to_numpy()  # rising for low ends, falling for high ends
        for p in range(top + 1):
            at = np.searchsorted(part, p, "right") if low else np.searchsorted(-part, -p, "right")
            out.append(side.iloc[at : at + k].assign(part=np.int32(p)))
    return pd.concat(out, ignore_index=True)[columns]


def _line_kernel(k: int, names: list[str], carry: tuple[str, ...]):
    def answer(right: pa.Table, left: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["key"]))
        values = right["value"].to_numpy().astype(float)
        asks = left["value"].to_numpy().astype(float)
        rows, pick, away, lengths = [], [], [], []
        for at in range(0, len(asks) if len(values) else 0, ROUTED_ROWS):
            cand, distance = _closest_on_line(asks[at : at + ROUTED_ROWS], values, k)
            rank = np.lexsort((cand, distance), axis=1)[:, :k]
            cand, distance = np.take_along_axis(cand, rank, 1), np.take_along_axis(distance, rank, 1)
            known = np.isfinite(distance)
            rows.append(np.arange(at, at + len(cand)))
            pick.append(cand[known])
            away.append(distance[known])
            lengths.append(known.sum(axis=1))
        found = _listed(rows, pick, away, lengths, right, carry, values[:, None] if "base_vector" in names else None)
        own = left.take(pa.array(_joined(rows, np.int64)))
        return pa.table({"view": own["view"], "value": own["value"], **found}).select(names)

    return answer


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def _listed(
    rows: list, pick: list, away: list, lengths: list, right: pa.Table, carry: Sequence[str], vectors: np.ndarray | None
) -> dict[str, pa.Array]:
    """Lists of ``distance, base_key``, carried columns and vectors, in the order of ``rows``."""
    at = pa.array(_joined(pick, np.int64))
    ends = pa.array(np.concatenate([[0], np.cumsum(_joined(lengths, np.int64))]).astype(np.int32))

    def lists(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(ends, values)

    out = {"distance": lists(pa.array(_joined(away, float))), "base_key": lists(_whole(right["key"]).take(at))}
    out |= {c: lists(_whole(right[c]).take(at)) for c in carry}
    if vectors is not None:
        flat = vectors[_joined(pick, np.int64)]
        inner = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1]))
        out["base_vector"] = lists(pa.ListArray.from_arrays(inner, pa.array(flat.ravel())))
    return out


def _cell_rows(width: int) -> int:
    """Rows wanted per cell: few pivots to look through, as boxes inside the cell leave out the most."""
    return 10_000 if width <= BOX_WIDTH else BLOCK_ROWS


def _most_rows(width: int) -> int:
    """Rows of a block or slice at most: of few features so many that hardly a cell is cut and its lists sent on."""
    return BLOCK_ROWS if width > BOX_WIDTH else 4 * BLOCK_ROWS


def nearest_lists(
    query: DataFrame,
    base: DataFrame,
    key: str,
    views: Sequence[Sequence[str]],
    k: int,
    metric: Metric = Metric(),
    carry: Sequence[str] = (),
    skip_self: bool = False,
    with_vectors: bool = False,
    cell_rows: int | None = None,
    block_rows: int | None = None,
    slice_rows: int | None = None,
    fold: Fold | None = None,
) -> DataFrame:
    """The k nearest base rows of each query row as a list, nearest first.

    Works for many views (subsets of the features) at once.  Returns ``view,
    key, near`` where ``near`` is an array of ``distance, base_key``, the
    ``carry`` columns of the base row and, with ``with_vectors``, its features
    as ``base_vector``.  Equal distances are ordered by base key.  ``skip_self``
    leaves out the base row with the query row's own key.  With ``fold`` ``near``
    is that expression of the list: what it leaves is written where lists would be.
    """
    folded = fold or (lambda near: near)
    rows = base.count()
    if rows < k + skip_self:
        raise ValueError(f"{k} neighbours need at least {k + skip_self} rows, found {rows}")
    lines = [i for i, view in enumerate(views) if len(view) == 1]
    if lines:
        single = [views[i][0] for i in lines]
        found = nearest_on_lines(query, base, key, single, k, carry, skip_self, with_vectors, fold)
        if len(lines) == len(views):
            return found
        others = [i for i, view in enumerate(views) if len(view) > 1]
        rest = nearest_lists(
            query, base, key, [views[i] for i in others], k, metric, carry, skip_self, with_vectors,
            cell_rows, block_rows, slice_rows, fold,
        )

        def named(part: DataFrame, numbers: list[int]) -> DataFrame:
            at = F.expr(f"element_at(array({', '.join(map(str, numbers))}), view + 1)")
            return part.withColumn("view", at)

        return named(found, lines).unionByName(named(rest, others))
    ask = _long(query, key, views, [])
    hold = _long(base, key, views, carry)
    names = sorted({f for view in views for f in view})
    columns = [[names.index(f) for f in view] for view in views]
    asked_rows = query.count()
    if cell_rows is None and len(views) * asked_rows * rows <= ONE_CELL_PAIRS:
        pivots = np.zeros((1, len(names)))
    else:
        wanted = cell_rows or _cell_rows(max(map(len, views)))
        pivots = _choose_pivots(base, key, names, rows, wanted, len(views) * (k + 1))
    most = _most_rows(max(map(len, views)))
    comparison = _Comparison(
        k, metric, tuple(carry), skip_self, with_vectors, hold.schema, block_rows or most, slice_rows or most
    )
    if len(pivots) == 1:
        asked = ask.withColumn("cell", F.col("view")).withColumn("bound", F.lit(float("inf")))
        plan = [(v, rows, asked_rows) for v in range(len(views))]
        found = comparison.run(asked, hold.withColumn("cell", F.col("view")), plan)
        return found.select("view", F.col("key").alias(key), folded(F.col("near")).alias("near"))

    k_plus = k + skip_self
    placed = _assign_cells(_first_copies(hold, k_plus), pivots, columns, metric)
    placed = stage_table(placed, "cells")
    cells = _summarise_cells(placed, pivots, columns, k_plus)
    placed = placed.drop("away")
    home = _assign_cells(ask, pivots, columns, metric)
    home = stage_table(
        home.select("view", "key", "vector", "cell").withColumn("bound", F.lit(float("inf"))),
        "home",
    )
    stored = _cell_counts(placed)
    first = comparison.run(home, placed, _plan(stored, home), keep=["vector", "cell"])
    kth = F.try_element_at("near", F.lit(k))["distance"]
    first = _visits(first.withColumn("bound", kth), cells, k_plus, metric)
    # a row whose list is whole leaves its answer; only the others keep their lists, until those of further cells come
    whole = F.size("visits") == 0
    first = stage_table(first.select(
        "view", "key", "visits", F.when(whole, folded(F.col("near"))).alias("answer"),
        *[F.when(~whole, F.col(c)).alias(c) for c in ("near", "vector", "bound")],
    ), "first")
    visiting = first.where(~whole)
    routed = visiting.select("view", "key", "vector", F.explode("visits").alias("cell"), "bound")
    second = comparison.lists(routed, placed, _plan(stored, routed))
    both = _merge(visiting.select("view", "key", "near").unionByName(second), k, [])
    answers = first.where(whole).select("view", "key", F.col("answer").alias("near"))
    answers = answers.unionByName(both.select("view", "key", folded(F.col("near")).alias("near")))
    return answers.select("view", F.col("key").alias(key), "near")


def _merge(parts: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """The k nearest out of the lists found in different blocks."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return parts.groupBy("view", "key").agg(
        best.alias("near"), *[F.any_value(c).alias(c) for c in keep]
    )


def _cell_counts(df: DataFrame) -> dict[int, int]:
    """Rows per cell: at most one entry per view and pivot."""
    return {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}


def _plan(stored: dict[int, int], asked: DataFrame) -> list[tuple[int, int, int]]:
    """(cell, base rows, query rows) of the cells that have both."""
    wanted = _cell_counts(asked)
    return [(c, stored[c], n) for c, n in sorted(wanted.items()) if c in stored]


def _cuts(
    plan: list[tuple[int, int, int]], block_rows: int, slice_rows: int, cores: int
) -> list[tuple[int, int, int]]:
    """(cell, blocks, slices) of each cell of the plan.

    Slices are cut finer while a group would hold more than its share of all row pairs,
    GROUPS_PER_CORE groups to a core, but not below 200 rows.
    """
    share = max(1, sum(base * rows for _, base, rows in plan) // (GROUPS_PER_CORE * cores))
    return [
        (c, -(-base // block_rows),
         max(-(-rows // slice_rows), min(-(-min(base, block_rows) * rows // share), -(-rows // 200))))
        for c, base, rows in plan
    ]


@dataclass(frozen=True)
class _Comparison:
    """Compares query rows with the base rows of the same cell."""

    k: int
    metric: Metric
    carry: tuple[str, ...]
    skip_self: bool
    with_vectors: bool
    base_schema: T.StructType
    block_rows: int
    slice_rows: int

    def run(
        self,
        asked: DataFrame,
        stored: DataFrame,
        plan: list[tuple[int, int, int]],
        keep: Sequence[str] = (),
    ) -> DataFrame:
        """``view, key, near`` (and ``keep``), at most k entries, within ``bound``; a row per query row.

        Only lists of cells that several blocks hold are merged.
        """
        cut = [one for one in plan if one[1] > self.block_rows]
        found = self.lists(asked, stored, [one for one in plan if one[1] <= self.block_rows] if cut else plan, keep)
        return found.unionByName(_merge(self.lists(asked, stored, cut, keep), self.k, keep)) if cut else found

    def lists(
        self,
        asked: DataFrame,
        stored: DataFrame,
        plan: list[tuple[int, int, int]],
        keep: Sequence[str] = (),
    ) -> DataFrame:
        """The rows of ``run`` before merging, one per query row and block it meets.

        A base row sits in one block and is copied to the slices of its cell; a
        query row sits in one slice and is copied to the blocks of its cell.
        """
        spark = asked.sparkSession
        cores = spark.sparkContext.defaultParallelism
        cuts = _cuts(plan, self.block_rows, self.slice_rows, cores)
        groups = sum(blocks * slices for _, blocks, slices in cuts)
        work = sum(base * rows for _, base, rows in plan)
        # A set number of tasks: the work grows with rows compared, not with
        # bytes, so merging small partitions by size would leave cores idle.
        tasks = max(1, min(2 * groups, max(8 * cores, work // WORK_PER_TASK), MAX_TASKS))
        cut = F.broadcast(spark.createDataFrame(cuts, "cell int, blocks int, slices int"))
        place = ["cell", "block", "slice"]
        digest = F.xxhash64("key")
        right = (
            stored.join(cut, "cell")
            .withColumn("block", F.pmod(digest, F.col("blocks")).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            .drop("blocks", "slices")
        )
        left = (
            asked.join(cut, "cell")
            .withColumn("slice", F.pmod(digest, F.col("slices")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .drop("blocks", "slices")
        )
        found = (
            left.repartition(tasks, *place).groupBy(*place)
            .cogroup(right.repartition(tasks, *place).groupBy(*place))
            .applyInArrow(self._kernel(keep), self._output(asked, keep))
        )
        lists = ["distance", "base_key", *self.carry]
        lists += ["base_vector"] if self.with_vectors else []
        return found.select("view", "key", F.arrays_zip(*lists).alias("near"), *keep)

    def _output(self, asked: DataFrame, keep: Sequence[str]) -> T.StructType:
        kind = self.base_schema["key"].dataType
        fields = [
            T.StructField("view", T.IntegerType()),
            T.StructField("key", kind),
            T.StructField("distance", T.ArrayType(T.DoubleType())),
            T.StructField("base_key", T.ArrayType(kind)),
            *[T.StructField(c, T.ArrayType(self.base_schema[c].dataType)) for c in self.carry],
        ]
        if self.with_vectors:
            fields.append(T.StructField("base_vector", T.ArrayType(T.ArrayType(T.DoubleType()))))
        return T.StructType([*fields, *[asked.schema[c] for c in keep]])

    def _kernel(self, keep: Sequence[str]):
        k, metric, carry = self.k, self.metric, self.carry
        skip_self, with_vectors = self.skip_self, self.with_vectors
        names = ["view", "key", "distance", "base_key", *carry]
        names += ["base_vector"] if with_vectors else []
        names += keep

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.take(pc.sort_indices(right["key"]))
            a, b = _vectors(left["vector"]), _vectors(right["vector"])
            own = np.full(len(a), -1)
            if skip_self and len(b) and len(a):
                asks, holds = left["key"].to_numpy(), right["key"].to_numpy()
                spot = np.minimum(np.searchsorted(holds, asks), len(holds) - 1)
                own = np.where(holds[spot] == asks, spot, -1)
            # a number that is missing or infinite is near to nothing
            sound, kept = np.flatnonzero(np.isfinite(a).all(axis=1)), np.flatnonzero(np.isfinite(b).all(axis=1))
            number = np.full(len(b) + 1, -1)
            number[kept] = np.arange(len(kept))
            bound = left["bound"].to_numpy().astype(float)
            counts = np.zeros(len(a), np.int64)
            rows, pick, away, lengths = [], [], [], []
            for at, picked, near in _within_reach(a[sound], b[kept], number[own[sound]], bound[sound], k, metric):
                at = sound[at]
                within = np.isfinite(near) & (near <= bound[at][:, None])
                rows.append(at)
                pick.append(kept[picked[within]])
                away.append(near[within])
                lengths.append(within.sum(axis=1))
                counts[at] = 1
            rest = np.flatnonzero(counts == 0)
            rows.append(rest)
            lengths.append(np.zeros(len(rest), np.int64))
            found = _listed(rows, pick, away, lengths, right, carry, b if with_vectors else None)
            mine = left.take(pa.array(_joined(rows, np.int64)))
            return pa.table({"view": mine["view"], "key": mine["key"], **found, **{c: mine[c] for c in keep}}).select(names)

        return compare


def _first_copies(hold: DataFrame, k: int) -> DataFrame:
    """Of rows with one and the same vector keep the k lowest keys.

    Exact: copies are equally far from any query row and ties go to the lower
    key, so a later copy can never be among the k nearest.
    """
    hold = hold.withColumn("__d", F.xxhash64("view", "vector"))
    crowded = stage_table(
        hold.groupBy("__d").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > k).select("__d"), "crowded"
    )
    if crowded.isEmpty():
        return hold.drop("__d")
    # only rows whose digest more than k rows hold are put in order, however many others there are
    order = Window.partitionBy("__d", "view", "vector").orderBy("key")
    shared = hold.join(crowded, "__d", "left_semi").withColumn("__n", F.row_number().over(order))
    alone = hold.join(crowded, "__d", "left_anti")
    return alone.unionByName(shared.where(F.col("__n") <= k).drop("__n")).drop("__d")


def _choose_pivots(
    base: DataFrame, key: str, names: Sequence[str], rows: int, cell_rows: int, per_pivot: int
) -> np.ndarray:
    """About one pivot per ``cell_rows`` rows: the rows with the smallest key digests."""
    wanted = min(-(-rows // cell_rows), MAX_PIVOTS, max(1, MAX_SUMMARY // per_pivot))
    if wanted <= 2:
        return np.zeros((1, len(names)))
    vector = F.expr(f"array({', '.join(map(double, names))})").alias("vector")
    digest = F.md5(F.col(key).cast("string"))
    first = base.select(vector, digest.alias("h")).orderBy("h").limit(wanted).collect()
    return np.unique(np.array([r["vector"] for r in first], dtype=float), axis=0)
