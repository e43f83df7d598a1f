"""Single decision trees, split exactly at any value, level by level.

A level is one pass: rows of open nodes become counts per class of each (node, feature,
value).  Lines of values are cut into parts of about PART_ROWS rows; the totals of the
parts before it are a part's start, so running class counts need no task to hold a whole
feature.  Every value that is followed by another one in its node is a possible split,
halfway between the two; the one that lowers the impurity most is taken (of equal ones the
first feature, then the lowest value), until nodes are pure, too small or as deep as wanted.
There are no bins and there is no limit of depth; one row per open node leaves the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rarelane.estimators.base import take_settings, with_scores
from rarelane.estimators.boosted import Tree
from rarelane.session import stage_table

# Default settings.
DEFAULTS = {"max_depth": None, "min_samples_leaf": 1, "min_samples_split": 2, "criterion": "gini"}
UNUSED = ["splitter", "max_bins", "random_state"]
#: Rows of a part of a feature's line, and the most parts; their ends are collected.
PART_ROWS, MAX_PARTS = 1_000_000, 4_096
#: Rows a task works on at once.
ROWS = 1 << 15


@dataclass(frozen=True)
class TreeModel:
    """A tree whose leaves hold the positive share of their rows."""

    features: tuple[str, ...]
    tree: Tree

    def score(self, df: DataFrame) -> DataFrame:
        """A row with a missing feature has no probability."""
        tree = self.tree

        @F.pandas_udf("double")
        def share(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                yield pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, tree.add(x)))

        scored = df.withColumn("__share", share(*[F.col(f"`{f}`").cast("double") for f in self.features]))
        return with_scores(scored, F.when(~F.isnan("__share"), F.col("__share"))).drop("__share")

    def parameters(self) -> list[tuple[str, str, float]]:
        return [("leaf", str(n), v) for n, (f, v) in enumerate(zip(self.tree.feature, self.tree.value)) if f < 0]

    @property
    def trees(self) -> tuple[Tree, ...]:
        return (self.tree,)


def _part_ends(train: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    parts = min(MAX_PARTS, -(-train.count() // PART_ROWS))
    if parts < 2:
        return [np.empty(0)] * len(features)
    shares = [i / parts for i in range(1, parts)]
    found = train.agg(*[
        F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, 100 * parts).alias(f"e{i}") for i, f in enumerate(features)
    ]).first()
    return [np.unique(found[f"e{i}"]) for i in range(len(features))]


def _counts(rows: DataFrame, tree: Tree, open_nodes: list[int], ends: list[np.ndarray], names: Sequence[str]) -> DataFrame:
    """``node, feature, part, value, n0, n1`` of the rows in open nodes."""
    width = len(ends)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_node = np.zeros(len(tree.feature), bool)
        open_node[open_nodes] = True
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(width)])
                for name, missing in zip(names, np.isnan(x).any(axis=0)):
                    if missing:
                        raise ValueError(f"feature {name} has missing values")
                node = tree.place(x)
                inside = open_node[node]
                node, x, y = node[inside], x[inside], batch.column(0).to_numpy(zero_copy_only=False)[inside]
                for f in range(width):
                    order = np.lexsort((x[:, f], node))
                    own, value, label = node[order], x[order, f], y[order]
                    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])[: len(own)])
                    if not len(first):
                        continue
                    n1 = np.add.reduceat(label, first).astype(np.int64)
                    n = np.diff([*first, len(own)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[first].astype(np.int32)), pa.array(np.full(len(first), f, np.int32)),
                         pa.array(np.searchsorted(ends[f], value[first]).astype(np.int32)), pa.array(value[first]),
                         pa.array(n - n1), pa.array(n1)],
                        ["node", "feature", "part", "value", "n0", "n1"],
                    )

    found = rows.mapInArrow(make, "node int, feature int, part int, value double, n0 long, n1 long")
    return found.groupBy("node", "feature", "part", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _pure(n0: Column, n1: Column, criterion: str) -> Column:
    """What a side counts: the purer, the more."""
    n = n0 + n1
    if criterion == "gini":
        return (n0 * n0 + n1 * n1) / n

    def part(k):
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    return part(n0) + part(n1)


def best_splits(counts: DataFrame, s: Mapping[str, Any]) -> DataFrame:
    """Per node its class counts ``n0, n1`` and its best split: ``feature, cut, l0, l1`` (null: none)."""
    counts = stage_table(counts, "tree_counts")
    whole = Window.partitionBy("node", "feature")
    to = whole.orderBy("part")
    totals = counts.groupBy("node", "feature", "part").agg(
        F.sum("n0").alias("p0"), F.sum("n1").alias("p1"), F.min("value").alias("low")
    )
    before = to.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "node", "feature", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("p0", "b0"), ("p1", "b1"))],
        F.sum("p0").over(whole).alias("t0"), F.sum("p1").over(whole).alias("t1"), F.lead("low").over(to).alias("next_low"),
    )
    own = Window.partitionBy("node", "feature", "part").orderBy("value")
    run = counts.join(starts, ["node", "feature", "part"]).select(
        "node", "feature", "value", "t0", "t1",
        (F.col("b0") + F.sum("n0").over(own)).cast("double").alias("l0"), (F.col("b1") + F.sum("n1").over(own)).cast("double").alias("l1"),
        F.coalesce(F.lead("value").over(own), "next_low").alias("next"),
    )
    r0, r1, least = F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1"), int(s["min_samples_leaf"])
    fits = F.col("next").isNotNull() & (F.col("l0") + F.col("l1") >= least) & (r0 + r1 >= least)
    kind = "gini" if s["criterion"] == "gini" else "entropy"
    gain = _pure(F.col("l0"), F.col("l1"), kind) + _pure(r0, r1, kind)
    cut = F.col("value") + (F.col("next") - F.col("value")) / 2
    rated = run.withColumn("gain", F.when(fits, F.round(gain, 7))).withColumn("cut", F.when(cut < F.col("next"), cut).otherwise(F.col("value")))
    order = F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("feature"), -F.col("value")))
    best = F.max_by(F.struct("gain", "feature", "cut", "l0", "l1"), order).alias("b")
    return rated.groupBy("node").agg(best, F.first("t0").alias("n0"), F.first("t1").alias("n1")).select(
        "node", "n0", "n1", "b.gain", "b.feature", "b.cut", "b.l0", "b.l1"
    )


def fit_tree(
    train: DataFrame, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any]
) -> TreeModel:
    """A tree on 0/1 labels.  Features must not be missing."""
    s = take_settings(settings, DEFAULTS, UNUSED)
    if s["criterion"] not in ("gini", "entropy", "log_loss"):
        raise ValueError(f"unknown criterion {s['criterion']!r}: expected 'gini', 'entropy' or 'log_loss'")
    columns = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = stage_table(train.select(F.col(f"`{label}`").cast("double").alias("y"), *columns), "tree_rows")
    ends = _part_ends(rows, [f"x{i}" for i in range(len(features))])
    tree, open_nodes, level = Tree.root(), [0], 0
    depth = None if s["max_depth"] is None else int(s["max_depth"])
    if depth is not None and depth < 0:
        raise ValueError("max_depth must not be negative")
    while open_nodes:
        following = []
        for r in best_splits(_counts(rows, tree, open_nodes, ends, features), s).collect():  # a row per open node
            n = r["n0"] + r["n1"]
            if level == 0:
                tree.value[0] = r["n1"] / n
            if r["gain"] is None or not r["n0"] or not r["n1"] or n < int(s["min_samples_split"]) or depth == 0:
                continue
            left, right = tree.split(r["node"], r["feature"], r["cut"])
            for side, n0, n1 in ((left, r["l0"], r["l1"]), (right, r["n0"] - r["l0"], r["n1"] - r["l1"])):
                tree.value[side] = n1 / (n0 + n1)
                if n0 and n1 and n0 + n1 >= int(s["min_samples_split"]):
                    following.append(side)
        level += 1
        open_nodes = following if depth is None or level < depth else []
    return TreeModel(tuple(features), tree)


def tree_sql(source: str, label: str, features: Sequence[str], depth: int, fit_on: str = "TRUE") -> str:
    """CTEs that end in ``scored``: all columns of ``source`` and ``probability``; for small tables."""
    parts = [f"n0 AS MATERIALIZED (SELECT *, ({fit_on}) AS fits, CAST(1 AS BIGINT) AS node, TRUE AS deeper FROM {source})"]
    for level in range(depth):
        cells = " UNION ALL ".join(
            f"SELECT node, {i} AS feature, CAST({f} AS DOUBLE) AS value, {label} AS y FROM n{level} WHERE fits AND deeper"
            for i, f in enumerate(features)
        )
        parts.append(f"""
c{level} AS MATERIALIZED (SELECT node, feature, value, CAST(sum(1 - y) AS DOUBLE) AS n0, CAST(sum(y) AS DOUBLE) AS n1 FROM ({cells}) GROUP BY 1, 2, 3),
r{level} AS MATERIALIZED (SELECT node, feature, value, lead(value) OVER w AS next, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1,
    sum(n0) OVER a AS t0, sum(n1) OVER a AS t1
  FROM c{level} WINDOW w AS (PARTITION BY node, feature ORDER BY value), a AS (PARTITION BY node, feature)),
s{level} AS MATERIALIZED (SELECT * FROM (SELECT *, value + (next - value) / 2 AS cut, row_number() OVER (PARTITION BY node
    ORDER BY round((l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (t0 - l0 + t1 - l1), 7) DESC, feature, value) AS place
  FROM r{level} WHERE next IS NOT NULL AND t0 > 0 AND t1 > 0) WHERE place = 1),
n{level + 1} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN s.node IS NULL THEN t.node
    WHEN list_extract([{", ".join("t." + f for f in features)}], s.feature + 1) <= s.cut THEN 2 * t.node ELSE 2 * t.node + 1 END AS node,
    s.node IS NOT NULL AS deeper) FROM n{level} t LEFT JOIN s{level} s ON s.node = t.node AND t.deeper)""")
    parts.append(f"leaves AS (SELECT node, avg({label}) AS probability FROM n{depth} WHERE fits GROUP BY 1)")
    parts.append(f"scored AS (SELECT t.*, probability FROM n{depth} t JOIN leaves USING (node))")
    return ",".join(parts)
