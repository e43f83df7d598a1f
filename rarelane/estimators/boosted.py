"""Gradient boosted trees, grown level by level from sums that Spark makes.

Each level of a tree is one aggregate: the sums of first and second derivatives of the
loss per (open node, feature, bin).  Running sums over the bins give the gain of every
split; one best split per node leaves the cluster.  With soft(G) the gradient sum drawn
towards zero by ``reg_alpha``, a node is worth soft(G)^2 / (H + reg_lambda), and a split

* leaves a second-derivative sum of ``min_child_weight`` on both sides at least,
* gains more than nothing and ``gamma`` at least: value of both sides less that of the node.

Of equal gains (nine digits) the first feature and the lowest bin win.  A leaf adds
-learning_rate soft(G) / (H + reg_lambda) to the margin, nothing if H is below
``min_child_weight``.

Rows are kept as one staged table of bins and margins.  Trees grown since it was written
are applied in the tasks; every HELD rounds the table is written again, to two folders in
turn, so it never takes more than twice its size.  A share of rows (``subsample``) is drawn
by digest of key and round, a share of features (``colsample_bytree``) by digest of name and
round, so lost tasks repeat the same sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rarelane.estimators.base import sigmoid, take_settings, with_scores
from rarelane.functions.draws import DRAW_DIGITS, DRAW_RANGE, unit_draw
from rarelane.session import staging_path

# Default settings.
DEFAULTS = {
    "n_estimators": 3093,
    "min_child_weight": 96,
    "max_depth": 12,
    "learning_rate": 0.07516,
    "subsample": 0.95,
    "colsample_bytree": 0.95,
    "reg_lambda": 1.50,
    "reg_alpha": 1.50,
    "gamma": 1.50,
    "max_bin": 512,
    "random_state": 228,
}
UNUSED = ["objective", "tree_method", "eval_metric", "n_jobs"]

#: Rounds whose trees tasks apply before the margins are written.
HELD = 16
#: Sums that a task holds at once; more are handed on per batch of rows.
DENSE_CELLS = 1 << 21
#: Rows a task works on at once.
ROWS = 1 << 15
#: Quantiles are off by one of so many parts of the rows at most.
ACCURACY = 100_000
#: A gain must be more than this.
LEAST_GAIN = 1e-6
#: The second derivative of a row is this at least.
LEAST_HESSIAN = 1e-16


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1.  Left: bin (or value) up to ``cut``."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    @staticmethod
    def root() -> Tree:
        return Tree([-1], [0.0], [-1], [-1], [0.0])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
        return at, at + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x``."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        cut = np.array(self.cut)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def add(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.place(x)]


@dataclass(frozen=True)
class BoostedModel:
    """Trees whose cuts are values of the features."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    def margin_of(self, x: np.ndarray) -> np.ndarray:
        return sum((t.add(x) for t in self.trees), np.zeros(len(x)))

    def score(self, df: DataFrame) -> DataFrame:
        """A row with a missing feature has no probability."""
        margin_of = self.margin_of

        @F.pandas_udf("double")
        def margin(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                yield pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, margin_of(x)))

        scored = df.withColumn("__margin", margin(*[F.col(f"`{f}`").cast("double") for f in self.features]))
        known = F.when(~F.isnan("__margin"), sigmoid(F.col("__margin")))
        return with_scores(scored, known).drop("__margin")

    def parameters(self) -> list[tuple[str, str, float]]:
        return [
            (f"leaf:{t}", str(n), v)
            for t, tree in enumerate(self.trees) for n, (f, v) in enumerate(zip(tree.feature, tree.value)) if f < 0
        ]


def node_rows(trees: Sequence[Tree]) -> list[tuple]:
    """A row per node, with the columns NODE_COLUMNS."""
    return [
        (t, n, *row) for t, tree in enumerate(trees)
        for n, row in enumerate(zip(tree.feature, tree.cut, tree.left, tree.right, tree.value))
    ]


def trees_of(rows: Sequence[tuple]) -> tuple[Tree, ...]:
    trees: dict[int, list[tuple]] = {}
    for t, _, *row in sorted(rows, key=lambda r: r[:2]):
        trees.setdefault(t, []).append(row)
    return tuple(Tree(*map(list, zip(*trees[t]))) for t in sorted(trees))


NODE_COLUMNS = "tree int, node int, feature int, cut double, left int, right int, value double"


def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Inner edges of at most ``bins`` quantile bins per feature: one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    if not shares:
        return [np.empty(0) for _ in features]
    found = train.agg(*[
        F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, max(ACCURACY, 100 * bins)).alias(f"e{i}")
        for i, f in enumerate(features)
    ]).first()
    return [np.unique(np.array(found[f"e{i}"] or [], dtype=float)) for i in range(len(features))]


def _state(train: DataFrame, key: str, label: str, features: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """``key, y, bins, margin``: bins as unsigned 16-bit numbers, one after the other."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(features))]
            for f, column in zip(features, x):
                if np.isnan(column).any():
                    raise ValueError(f"feature {f} has missing values")
            bins = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x)]).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], pa.binary()),
                 pa.array(np.zeros(len(bins)))],
                ["key", "y", "bins", "margin"],
            )

    columns = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    return train.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{label}`").cast("double").alias("y"), *columns).mapInArrow(
        make, "key string, y double, bins binary, margin double"
    )


def _bins(column: pa.Array, features: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u2").reshape(-1, features)


class _Rows:
    """The staged rows, and the trees grown since they were written."""

    def __init__(self, first: DataFrame, features: int):
        self.spark, self.features = first.sparkSession, features
        self.paths = [staging_path(self.spark, "boosted") for _ in range(2)]
        self.turn, self.held = 0, []
        self._write(first)

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.paths[self.turn])
        self.table = self.spark.read.schema("key string, y double, bins binary, margin double").parquet(self.paths[self.turn])
        self.turn = 1 - self.turn

    def keep(self, tree: Tree) -> None:
        self.held.append(tree)
        if len(self.held) == HELD:
            held, features = self.held, self.features

            def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margin = _margins(batch, held, features)
                    yield batch.set_column(3, "margin", pa.array(margin))

            self._write(self.table.mapInArrow(move, self.table.schema))
            self.held = []


def _margins(batch: pa.RecordBatch, held: list[Tree], features: int) -> np.ndarray:
    x = _bins(batch.column("bins"), features)
    return sum((t.add(x) for t in held), batch.column("margin").to_numpy(zero_copy_only=False).copy())


def _sums(rows: _Rows, tree: Tree, open_nodes: list[int], used: list[int], bins: int, taken) -> DataFrame:
    """``node, feature, bin, g, h`` summed over the rows that lie in open nodes."""
    held, features = list(rows.held), rows.features
    names = ["node", "feature", "bin", "g", "h"]

    def cells(total: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        node, rest = np.divmod(number, len(used) * bins)
        feature, own = np.divmod(rest, bins)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(open_nodes, np.int32)[node]), pa.array(np.array(used, np.int32)[feature]),
             pa.array(own.astype(np.int32)), pa.array(total[0]), pa.array(total[1])], names,
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(open_nodes) * len(used) * bins
        dense = np.zeros((2, size)) if size <= DENSE_CELLS else None
        slot = np.full(len(tree.feature), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _bins(batch.column("bins"), features)
                margin = sum((t.add(x) for t in held), batch.column("margin").to_numpy(zero_copy_only=False).copy())
                p = 1.0 / (1.0 + np.exp(-margin))
                own = slot[tree.place(x)]
                inside = own >= 0
                own, x, p = own[inside], x[inside], p[inside]
                g = p - batch.column("y").to_numpy(zero_copy_only=False)[inside]
                h = np.maximum(p * (1.0 - p), LEAST_HESSIAN)
                cell = ((own[:, None] * len(used) + np.arange(len(used))) * bins + x[:, used]).ravel()
                g, h = (np.repeat(v, len(used)) for v in (g, h))
                if dense is not None:
                    dense[0] += np.bincount(cell, g, size)
                    dense[1] += np.bincount(cell, h, size)
                elif len(cell):
                    number, place = np.unique(cell, return_inverse=True)
                    yield cells(np.stack([np.bincount(place, v, len(number)) for v in (g, h)]), number)
        if dense is not None and len(number := np.flatnonzero(dense[1])):
            yield cells(dense[:, number], number)

    table = rows.table if taken is None else rows.table.where(taken)
    parts = table.select("y", "bins", "margin").mapInArrow(make, "node int, feature int, bin int, g double, h double")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, s: Mapping[str, Any]) -> DataFrame:
    """Per node its sums ``g, h``, and its best split: ``gain, feature, bin, gl, hl`` (null: none)."""
    alpha, lam, least = (float(s[n]) for n in ("reg_alpha", "reg_lambda", "min_child_weight"))

    def value(g, h):
        drawn = F.greatest(F.abs(g) - alpha, F.lit(0.0))
        return F.when(h + lam > 0, drawn * drawn / (h + lam)).otherwise(0.0)

    own = Window.partitionBy("node", "feature")
    to = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select(
        "node", "feature", "bin", F.sum("g").over(to).alias("gl"), F.sum("h").over(to).alias("hl"),
        F.sum("g").over(own).alias("g"), F.sum("h").over(own).alias("h"),
    )
    gain = value(F.col("gl"), F.col("hl")) + value(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - value(F.col("g"), F.col("h"))
    # the last bin of a feature leaves nothing on the right
    fits = (F.col("hl") >= least) & (F.col("h") - F.col("hl") >= least) & (F.col("h") - F.col("hl") > 1e-12)
    rated = run.withColumn("gain", F.when(fits, gain)).withColumn(
        "gain", F.when((F.col("gain") > LEAST_GAIN) & (F.col("gain") >= float(s["gamma"])), F.round("gain", 9))
    )
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    best = F.max_by(F.struct("gain", "feature", "bin", "gl", "hl"), F.when(F.col("gain").isNotNull(), order))
    # all features see the same rows: the sums of the first one are the node's
    total = F.min_by(F.struct("g", "h"), F.col("feature"))
    return rated.groupBy("node").agg(best.alias("b"), total.alias("t")).select("node", "t.g", "t.h", "b.gain", "b.feature", "b.bin", "b.gl", "b.hl")


def used_features(names: Sequence[str], share: float, seed: int, turn: int) -> list[int]:
    """The features of a round: those of least digest."""
    count = max(1, int(share * len(names)))
    order = sorted(range(len(names)), key=lambda i: hashlib.md5(f"feature|{seed}|{turn}|{names[i]}".encode()).hexdigest())
    return sorted(order[:count])


def grow(rows: _Rows, names: Sequence[str], edges: list[np.ndarray], s: Mapping[str, Any], turn: int) -> Tree:
    """One tree over bins; its leaves hold what they add to the margin."""
    share, seed = float(s["subsample"]), int(s["random_state"])
    used = used_features(names, float(s["colsample_bytree"]), seed, turn)
    bins = max(len(edges[i]) for i in used) + 1
    taken = None if share >= 1 else unit_draw("boost", f"{seed}|{turn}", F.col("key")) < share
    depth = int(s["max_depth"]) if s["max_depth"] else 0
    tree, open_nodes, level = Tree.root(), [0], 0
    while open_nodes:
        following = []
        for r in best_splits(_sums(rows, tree, open_nodes, used, bins, taken), s).collect():  # a row per open node
            if level == 0:
                tree.value[0] = _leaf(r["g"], r["h"], s)
            if r["gain"] is None:
                continue
            left, right = tree.split(r["node"], r["feature"], float(r["bin"]))
            tree.value[left] = _leaf(r["gl"], r["hl"], s)
            tree.value[right] = _leaf(r["g"] - r["gl"], r["h"] - r["hl"], s)
            # a side that cannot be cut in two that are heavy enough is a leaf
            sides = ((left, r["hl"]), (right, r["h"] - r["hl"]))
            following += [n for n, h in sides if h >= 2 * float(s["min_child_weight"])]
        level += 1
        open_nodes = following if not depth or level < depth else []
    return tree


def _leaf(g: float, h: float, s: Mapping[str, Any]) -> float:
    if h < float(s["min_child_weight"]) or h + float(s["reg_lambda"]) <= 0:
        return 0.0
    drawn = np.sign(g) * max(abs(g) - float(s["reg_alpha"]), 0.0)
    return float(-float(s["learning_rate"]) * drawn / (h + float(s["reg_lambda"])))


def fit_boosted(
    train: DataFrame, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any]
) -> BoostedModel:
    """Boosted trees from a margin of zero.  Features must not be missing."""
    s = take_settings(settings, DEFAULTS, UNUSED)
    if not 2 <= int(s["max_bin"]) <= 1 << 16:
        raise ValueError(f"max_bin {s['max_bin']}: 2 to 65536 bins")
    edges = bin_edges(train, features, int(s["max_bin"]))
    rows = _Rows(_state(train, key, label, features, edges), len(features))
    trees = []
    for turn in range(int(s["n_estimators"])):
        tree = grow(rows, features, edges, s, turn)
        trees.append(tree)
        rows.keep(tree)
        still = len(tree.feature) == 1 and tree.value[0] == 0.0
        if still and float(s["subsample"]) >= 1 and float(s["colsample_bytree"]) >= 1:
            break  # every further round would find the same
    return BoostedModel(tuple(features), tuple(_valued(t, edges) for t in trees))


def _valued(tree: Tree, edges: list[np.ndarray]) -> Tree:
    cut = [float(edges[f][int(c)]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
    return Tree(tree.feature, cut, tree.left, tree.right, tree.value)


# ---- the same in SQL ------------------------------------------------------

def boosted_sql(source: str, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any], fit_on: str = "TRUE") -> str:
    """CTEs that end in ``scored``: all columns of ``source`` and ``margin``; for small tables and few rounds."""
    s = take_settings(settings, DEFAULTS, UNUSED)
    bins, alpha, lam = int(s["max_bin"]), float(s["reg_alpha"]), float(s["reg_lambda"])
    least, share, seed = float(s["min_child_weight"]), float(s["subsample"]), int(s["random_state"])
    parts = []
    for i, f in enumerate(features):
        parts.append(f"""
edge{i} AS MATERIALIZED (SELECT DISTINCT v FROM (SELECT {f} AS v, row_number() OVER (ORDER BY {f}) AS nth,
  count(*) OVER () AS n FROM {source} WHERE {fit_on}) r JOIN range(1, {bins}) c(i)
  ON nth = CAST(ceil(CAST(i AS DOUBLE) / {bins} * n) AS BIGINT)),
bin{i} AS MATERIALIZED (SELECT d.{f}, count(v) AS b FROM (SELECT DISTINCT {f} FROM {source}) d
  LEFT JOIN edge{i} ON v < d.{f} GROUP BY 1)""")
    bin_columns = ", ".join(f"bin{i}.b AS b{i}" for i in range(len(features)))
    joins = " ".join(f"JOIN bin{i} ON bin{i}.{f} = s.{f}" for i, f in enumerate(features))
    parts.append(f"m0 AS MATERIALIZED (SELECT s.*, ({fit_on}) AS fits, {bin_columns}, CAST(0 AS DOUBLE) AS margin FROM {source} s {joins})")

    def worth(g, h):
        return f"(power(greatest(abs({g}) - {alpha!r}, 0), 2) / ({h} + {lam!r}))"

    for turn in range(int(s["n_estimators"])):
        used = used_features(features, float(s["colsample_bytree"]), seed, turn)
        draw = f"('0x' || substr(md5('boost|{seed}|{turn}|' || CAST({key} AS VARCHAR)), 1, {DRAW_DIGITS}))::BIGINT / {DRAW_RANGE!r} < {share!r}"
        drawn = "TRUE" if share >= 1 else draw
        parts.append(f"t{turn}_0 AS MATERIALIZED (SELECT *, fits AND {drawn} AS taken, CAST(1 AS BIGINT) AS node, TRUE AS deeper, 1 / (1 + exp(-margin)) AS p FROM m{turn})")
        for level in range(int(s["max_depth"])):
            cells = " UNION ALL ".join(
                f"SELECT node, {i} AS feature, b{i} AS bin, p - {label} AS g, greatest(p * (1 - p), 1e-16) AS h "
                f"FROM t{turn}_{level} WHERE taken AND deeper" for i in used
            )
            name = f"{turn}_{level}"
            parts.append(f"""
h{name} AS MATERIALIZED (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM ({cells}) GROUP BY 1, 2, 3),
r{name} AS MATERIALIZED (SELECT node, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS g, sum(h) OVER a AS h
  FROM h{name} WINDOW w AS (PARTITION BY node, feature ORDER BY bin), a AS (PARTITION BY node, feature)),
s{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS place
  FROM (SELECT *, round({worth("gl", "hl")} + {worth("g - gl", "h - hl")} - {worth("g", "h")}, 9) AS gain FROM r{name}
    WHERE hl >= {least!r} AND h - hl >= {least!r} AND h - hl > 1e-12)
  WHERE gain > {LEAST_GAIN!r} AND gain >= {float(s["gamma"])!r}) WHERE place = 1),
t{turn}_{level + 1} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN s.node IS NULL THEN t.node
    WHEN list_extract([{", ".join(f"b{i}" for i in range(len(features)))}], s.feature + 1) <= s.bin THEN 2 * t.node ELSE 2 * t.node + 1 END AS node,
    s.node IS NOT NULL AS deeper) FROM t{name} t LEFT JOIN s{name} s ON s.node = t.node AND t.deeper)""")
        last = f"t{turn}_{int(s['max_depth'])}"
        parts.append(f"""
l{turn} AS MATERIALIZED (SELECT node, CASE WHEN h < {least!r} THEN 0 ELSE
    -{float(s["learning_rate"])!r} * sign(g) * greatest(abs(g) - {alpha!r}, 0) / (h + {lam!r}) END AS add
  FROM (SELECT node, sum(p - {label}) AS g, sum(greatest(p * (1 - p), 1e-16)) AS h FROM {last} WHERE taken GROUP BY 1)),
m{turn + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (taken, node, deeper, p) REPLACE (margin + coalesce(add, 0) AS margin) FROM {last} t LEFT JOIN l{turn} USING (node))""")
    parts.append(f"scored AS (SELECT * FROM m{int(s['n_estimators'])})")
    return ",".join(parts)
