"""Vote ensemble: many small learners, weights from one quadratic problem.

Each learner sees a few features and votes -1 or +1.  With H the votes and y the
signed labels, the weights w minimise w'(H'H + lambda I)w - 2(H'y)'w over a box
(or over 0/1 choices).  Learners with a closed form (discriminant, naive Bayes)
are all fitted from ONE pass of class moments, logistic learners by Newton steps
that serve every learner in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rarelane.estimators import bayes, binned, discriminant, knn, newton
from rarelane.estimators.base import take_settings
from rarelane.estimators.choices import proven_choice
from rarelane.estimators.gram import Votes, bounded_weights, collected_products, product_table
from rarelane.estimators.logistic import class_weights
from rarelane.estimators.moments import ClassMoments, class_moments, product_sums
from rarelane.functions.text import number, quoted
from rarelane.operators.neighbours import Metric, nearest_lists
from rarelane.session import stage_table

# Default settings.
DEFAULTS = {
    "weak_cls_type": "knn",
    "weak_cls_schedule": 1,
    "weak_cls_params": None,
    "lambda_coef": 0.0,
}
#: Whether 0/1 weights are proven best; not a setting of the fixed list.
PROVE = {"prove": False}
UNUSED = [
    "weak_cls_strategy", "relaxation_schedule", "num_samples", "optimization_method", "classical",
]
LOGISTIC_DEFAULTS = {"penalty": "l2", "C": 1.0, "max_iter": 100, "class_weight": None, "tol": 1e-6, "l1_ratio": None}
# 0/1 weights: starting points of the descent, and seed of the random ones.
BINARY_STARTS, BINARY_SEED = 256, 97
# Fewer learners than this are scored by generated column arithmetic.
SQL_LEARNERS = 64
# For 0/1 weights the collected H'H may hold this many numbers at most (128 MB).
MAX_GRAM_CELLS = 16_000_000
ROWS_PER_CHUNK = 2_000


def subsets(features: Sequence[str], schedule: int) -> list[tuple[int, ...]]:
    """Feature positions of every learner: all subsets of size 1 .. schedule."""
    return [
        c for size in range(1, schedule + 1) for c in combinations(range(len(features)), size)
    ]


def subset_table(spark: SparkSession, features: Sequence[str], schedule: int) -> DataFrame:
    rows = [(i, [features[j] for j in c]) for i, c in enumerate(subsets(features, schedule))]
    return spark.createDataFrame(rows, "learner int, features array<string>")


class MatrixLearners:
    """Learners that vote on a batch of rows at once: ``matrix(x)`` is rows x learners."""

    features: tuple[str, ...]
    members: list[tuple[int, ...]]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def only(self, used: Sequence[int]) -> MatrixLearners:
        raise NotImplementedError

    def votes(self, df: DataFrame) -> DataFrame:
        """Add ``votes``: one -1/+1 per learner."""
        matrix = self.matrix

        @F.pandas_udf("array<int>")
        def every(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                yield pd.Series(list(matrix(x).astype(np.int32)))

        return df.withColumn("votes", every(*[F.col(f) for f in self.features]))

    def source(self, train: DataFrame, label: str) -> Votes:
        """Votes straight from the features, which never leave the task."""
        names, count = list(self.features), len(self.members)

        def read(batch: pa.RecordBatch, used: np.ndarray | None):
            votes = self.matrix if used is None else self.only(used.tolist()).matrix
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            y = 2.0 * batch.column(0).to_numpy(zero_copy_only=False) - 1.0
            for at in range(0, len(x), ROWS_PER_CHUNK):
                part = slice(at, at + ROWS_PER_CHUNK)
                yield votes(x[part]), y[part]

        columns = [F.col(quoted(f)).cast("double").alias(f"x{i}") for i, f in enumerate(names)]
        return Votes(train.select(F.col(quoted(label)).cast("double").alias("label"), *columns), count, read)

    def gram(self, train: DataFrame, label: str) -> DataFrame:
        """``(i, j, total)`` of summed vote products; the signed label is the last voter."""
        return product_table(self.source(train, label))

    def raw_score(self, df: DataFrame, weights: np.ndarray, into: str) -> DataFrame:
        used = [int(i) for i in np.nonzero(weights)[0]]
        if not used:
            return df.withColumn(into, F.lit(0.0))
        votes, w = self.only(used).matrix, np.asarray(weights)[used]

        @F.pandas_udf("double")
        def total(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
                yield pd.Series(np.concatenate([
                    votes(x[at : at + ROWS_PER_CHUNK]) @ w
                    for at in range(0, max(len(x), 1), ROWS_PER_CHUNK)
                ]))

        return df.withColumn(into, total(*[F.col(f) for f in self.features]))


@dataclass(frozen=True)
class BinnedLearners(MatrixLearners):
    """Tree learners as vote tables over feature bins."""

    features: tuple[str, ...]
    members: list[tuple[int, ...]]
    edges: dict[int, list[np.ndarray]]
    tables: list[np.ndarray]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        votes = np.empty((len(x), len(self.members)))
        for n, columns in enumerate(self.members):
            size = len(columns)
            cell = binned.cell_numbers(x, columns, self.edges[size], binned.BINS[size])
            votes[:, n] = self.tables[n][cell]
        return votes

    def only(self, used: Sequence[int]) -> BinnedLearners:
        return BinnedLearners(
            self.features, [self.members[i] for i in used], self.edges,
            [self.tables[i] for i in used],
        )


@dataclass(frozen=True)
class SquareLearners(MatrixLearners):
    """Learners whose log odds are bias + slope . x + square . x^2 (one row each), x from the centre."""

    features: tuple[str, ...]
    members: list[tuple[int, ...]]
    square: np.ndarray
    slope: np.ndarray
    bias: np.ndarray
    centre: np.ndarray

    def vote(self, i: int) -> str:
        """Vote of learner ``i`` as SQL text."""
        terms = [number(self.bias[i])]
        for j in self.members[i]:
            x = quoted(self.features[j])
            if self.centre[j]:
                x = f"({x} - {number(self.centre[j])})"
            if self.square[i, j]:
                terms.append(f"{x} * ({number(self.square[i, j])} * {x} + {number(self.slope[i, j])})")
            else:
                terms.append(f"{x} * {number(self.slope[i, j])}")
        return f"CASE WHEN {' + '.join(terms)} > 0 THEN 1 ELSE -1 END"

    def votes(self, df: DataFrame) -> DataFrame:
        if len(self.members) > SQL_LEARNERS:
            return super().votes(df)
        every = ", ".join(self.vote(i) for i in range(len(self.members)))
        return df.withColumn("votes", F.expr(f"array({every})"))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        x = x - self.centre
        margin = x @ self.slope.T + self.bias
        if self.square.any():
            margin += (x * x) @ self.square.T
        return np.where(margin > 0, 1.0, -1.0)

    def only(self, used: Sequence[int]) -> SquareLearners:
        used = list(used)
        return SquareLearners(
            self.features, [self.members[i] for i in used], self.square[used],
            self.slope[used], self.bias[used], self.centre,
        )

    def raw_score(self, df: DataFrame, weights: np.ndarray, into: str) -> DataFrame:
        used = np.nonzero(weights)[0]
        if len(used) > SQL_LEARNERS:
            return super().raw_score(df, weights, into)
        terms = [f"({self.vote(int(i))}) * {number(weights[i])}" for i in used]
        return df.withColumn(into, F.expr(" + ".join([number(0.0), *terms])))


@dataclass(frozen=True)
class NeighbourLearners:
    """k-NN learners: one neighbour join answers all of them together."""

    features: tuple[str, ...]
    members: list[tuple[int, ...]]
    table: DataFrame
    key: str
    label: str
    k: int
    metric: Metric
    weights: str
    #: The train table and its votes, once they are written.
    kept: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict, compare=False)

    def long_votes(self, df: DataFrame, used: Sequence[int]) -> DataFrame:
        """``key, learner, vote`` for the learners in ``used``."""
        views = [[self.features[j] for j in self.members[i]] for i in used]

        def vote(near: Column) -> Column:
            return F.when(knn.vote(near, self.label, self.weights) > 0.5, 1).otherwise(-1)

        found = nearest_lists(
            df, self.table, self.key, views, self.k, self.metric, carry=[self.label], fold=vote
        )
        learner = F.expr(f"element_at(array({', '.join(map(str, used))}), view + 1)")
        return found.select(self.key, learner.alias("learner"), F.col("near").alias("vote"))

    def _voted(self, df: DataFrame) -> DataFrame:
        """Add ``__v``: learner and vote of every learner."""
        every = self.long_votes(df, range(len(self.members))).groupBy(self.key).agg(
            F.array_sort(F.collect_list(F.struct("learner", "vote"))).alias("__v")
        )
        return df.join(every, self.key)

    def votes(self, df: DataFrame) -> DataFrame:
        return self._voted(df).withColumn("votes", F.col("__v.vote")).drop("__v")

    def source(self, train: DataFrame, label: str) -> Votes:
        """Votes by one neighbour join, written once; scores of the same table read them again."""
        voted = stage_table(self._voted(train), "votes")
        self.kept["train"] = (train, voted)
        signed = voted.select(F.col(quoted(label)).cast("double").alias("label"), F.col("__v.vote").alias("votes"))
        return vote_source(signed, "label", len(self.members))

    def gram(self, train: DataFrame, label: str) -> DataFrame:
        """``(i, j, total)`` of summed vote products; the signed label is the last voter."""
        return product_table(self.source(train, label))

    def raw_score(self, df: DataFrame, weights: np.ndarray, into: str) -> DataFrame:
        used = [int(i) for i in np.nonzero(weights)[0]]
        if not used:
            return df.withColumn(into, F.lit(0.0))
        listed = ", ".join(map(number, weights))
        train, voted = self.kept.get("train", (None, None))
        if df is train:
            total = F.expr(f"aggregate(__v, 0.0D, (s, x) -> s + element_at(array({listed}), x.learner + 1) * x.vote)")
            return voted.withColumn(into, total).drop("__v")
        weight = F.expr(f"element_at(array({listed}), learner + 1)")
        sums = self.long_votes(df, used).groupBy(self.key).agg(
            F.sum(weight * F.col("vote")).alias(into)
        )
        return df.join(sums, self.key)


def vote_source(voted: DataFrame, label: str, learners: int, votes: str = "votes") -> Votes:
    """Votes that are kept as an array of each row."""

    def read(batch: pa.RecordBatch, used: np.ndarray | None):
        h = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, learners).astype(float)
        y = 2.0 * batch.column(0).to_numpy(zero_copy_only=False) - 1.0
        for at in range(0, len(h), ROWS_PER_CHUNK):
            part = slice(at, at + ROWS_PER_CHUNK)
            yield h[part] if used is None else h[part][:, used], y[part]

    return Votes(voted.select(F.col(quoted(label)).cast("double").alias("label"), F.col(votes).alias("votes")), learners, read)


def quadratic_terms(source: Votes, penalty: float = 0.0):
    """Collected ``J`` = H'H + penalty * I and ``C`` = -2 H'y."""
    learners = source.learners
    if (learners + 1) ** 2 > MAX_GRAM_CELLS:
        raise ValueError(f"{learners} learners are too many for a collected vote product")
    full = collected_products(source)
    return full[:-1, :-1] + penalty * np.eye(learners), -2.0 * full[:-1, -1]


def descend_binary(j: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Flips one weight, or where no single flip helps two at once, while the energy falls."""
    x = x.astype(float)
    field = j @ x
    own = np.diag(j)
    while True:
        sign = 1.0 - 2.0 * x
        one = sign * (2.0 * field + c) + own
        at = int(one.argmin())
        flips = [at]
        if one[at] >= -1e-9:
            two = one[:, None] + one[None, :] + 2.0 * np.outer(sign, sign) * j
            np.fill_diagonal(two, np.inf)
            if len(x) < 2 or two.min() >= -1e-9:
                return x, float(x @ field + c @ x)
            flips = list(np.unravel_index(two.argmin(), two.shape))
        for i in flips:
            field += sign[i] * j[:, i]
            x[i] = 1.0 - x[i]


def best_choice(spark: SparkSession, j: np.ndarray, c: np.ndarray) -> DataFrame:
    """One row ``(bits, energy)``: the 0/1 weights of least energy that were found.

    All learners compete, however many there are: descents from none, from all and
    from random choices run as Spark rows, and the lowest end wins; of equal energies
    the one that leaves out the last learner, then the one before it, and so on.
    """
    sent = spark.sparkContext.broadcast((j, c))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j, c = sent.value
        for batch in batches:
            ends = []
            for start in batch["id"].tolist():
                x = np.full(len(c), float(start))
                if start > 1:
                    draw = np.random.default_rng([BINARY_SEED, start])
                    x = (draw.random(len(c)) < draw.random()).astype(float)
                ends.append(descend_binary(j, c, x))
            yield pd.DataFrame({
                "energy": [e for _, e in ends], "bits": [x.astype(np.int32).tolist() for x, _ in ends]
            })

    tried = spark.range(BINARY_STARTS).mapInPandas(descend, "energy double, bits array<int>")
    best = F.min(F.struct(F.round("energy", 6).alias("energy"), F.reverse("bits").alias("last_first")))
    return tried.agg(best.alias("b")).select(F.reverse("b.last_first").alias("bits"), "b.energy")


def binary_choice(spark: SparkSession, j: np.ndarray, c: np.ndarray) -> DataFrame:
    """``best_choice`` of up to 62 learners as a bit pattern: ``(choice, energy)``."""
    if len(c) > 62:
        raise ValueError("a bit pattern holds at most 62 learners: use best_choice")
    pattern = F.aggregate("bits", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(1).cast("bigint").alias("bit")),
                          lambda s, b: F.struct((s["sum"] + s["bit"] * b).alias("sum"), (s["bit"] * 2).alias("bit")))
    return best_choice(spark, j, c).select(pattern["sum"].alias("choice"), "energy")


def solve_binary(spark: SparkSession, j: np.ndarray, c: np.ndarray, proof: bool = False) -> tuple[np.ndarray, float | None]:
    """0/1 weights of all learners, and with ``proof`` how much lower another choice could be at most."""
    bits = np.array(best_choice(spark, j, c).first()["bits"], dtype=float)
    if not proof:
        return bits, None
    row = proven_choice(spark, j, c, bits).first()
    return np.array(row["bits"], dtype=float), row["gap"]


def from_moments(
    moments: ClassMoments, schedule: int, kind: str, settings: Mapping[str, Any],
    quartic: np.ndarray | None = None,
) -> SquareLearners:
    """All discriminant or naive Bayes learners from one set of class moments."""
    members = subsets(moments.features, schedule)
    m = len(moments.features)
    square, slope = np.zeros((len(members), m)), np.zeros((len(members), m))
    bias = np.zeros(len(members))
    for n, columns in enumerate(members):
        part, at = moments.subset(columns), list(columns)
        if kind == "nb":
            a, b, bias[n] = bayes.fit_from_moments(
                part, settings.get("var_smoothing", bayes.DEFAULTS["var_smoothing"])
            )
            square[n, at], slope[n, at] = a, b
        else:
            slope[n, at], bias[n] = _small_discriminant(part, at, settings, quartic)
            bias[n] += slope[n, at] @ moments.centre[at]
    return SquareLearners(moments.features, members, square, slope, bias, moments.centre)


def _small_discriminant(part, at, settings, quartic):
    amount = settings.get("shrinkage")
    covs = part.covariances
    if amount == "auto":
        covs = []
        for c in (0, 1):
            spread = np.sqrt(np.maximum(np.diag(part.covariances[c]), 0.0))
            spread[spread <= 0] = 1.0
            scale = np.outer(spread, spread)
            q = quartic[c][np.ix_(at, at)].sum()
            covs.append(discriminant.auto_shrink(part.covariances[c] / scale, q, part.counts[c])
                        * scale)
    elif amount is not None:
        covs = [discriminant.shrink(c, float(amount)) for c in part.covariances]
    return discriminant.discriminant(
        part, settings.get("solver", "svd" if amount is None else "lsqr"),
        float(settings.get("tol", 1e-4)), covs,
    )


def squared_products(
    train: DataFrame, label: str, features: Sequence[str], moments: ClassMoments
) -> np.ndarray:
    """Per class the sums of z_i^2 z_j^2 of values scaled within the class: one pass."""
    z2 = []
    for i, f in enumerate(features):
        scaled = []
        for c in (0, 1):
            spread = float(np.sqrt(max(moments.covariances[c, i, i], 0.0))) or 1.0
            scaled.append(f"({quoted(f)} - {number(moments.means[c, i])}) / {number(spread)}")
        z = f"CASE WHEN {quoted(label)} = 1 THEN {scaled[1]} ELSE {scaled[0]} END"
        z2.append(f"pow({z}, 2) AS {quoted(f)}")
    sums = np.zeros((2, len(features) + 1, len(features) + 1))
    for r in product_sums(train.selectExpr(quoted(label), *z2), label, features).collect():
        sums[r["label"], r["i"], r["j"]] = sums[r["label"], r["j"], r["i"]] = r["total"]
    return sums[:, 1:, 1:]


def fit_logistic_learners(
    train: DataFrame, label: str, features: Sequence[str], schedule: int,
    settings: Mapping[str, Any],
) -> SquareLearners:
    """Newton steps for all learners together: one pass over the rows per step."""
    members = subsets(features, schedule)
    size = max(map(len, members))
    m, n = len(features), len(members)
    # Short subsets are padded with an all-zero column, number m.
    columns = np.array([[*c, *[m] * (size - len(c))] for c in members])
    settings = take_settings(settings, LOGISTIC_DEFAULTS, ["solver", "random_state", "n_jobs"])
    l1, l2 = newton.penalties(settings)
    heavy = np.ones(2)
    if settings["class_weight"] == "balanced":
        for row in class_weights(train, label).collect():
            heavy[int(row[label])] = row["weight"]
    elif settings["class_weight"] is not None:
        for c, value in settings["class_weight"].items():
            heavy[int(c)] = float(value)
    theta = newton.fit_learners(
        train, label, features, members, heavy, l1, l2, int(settings["max_iter"]), float(settings["tol"])
    )
    slope = np.zeros((n, m + 1))
    slope[np.arange(n)[:, None], columns] = theta[:, :size]
    return SquareLearners(
        tuple(features), members, np.zeros((n, m)), slope[:, :m], theta[:, size], np.zeros(m)
    )


def fit_learners(
    train: DataFrame, key: str, label: str, features: Sequence[str], kind: str, schedule: int,
    settings: Mapping[str, Any],
):
    """All weak learners of one kind."""
    members = subsets(features, schedule)
    if kind in ("lda", "nb"):
        moments = class_moments(train, label, features)
        quartic = None
        if kind == "lda" and settings.get("shrinkage") == "auto":
            quartic = squared_products(train, label, features, moments)
        return from_moments(moments, schedule, kind, settings, quartic)
    if kind == "lg":
        return fit_logistic_learners(train, label, features, schedule, settings)
    if kind == "knn":
        settings = {"n_neighbors": 5, "weights": "uniform", **settings}
        whole = knn.fit(train, key, label, features, settings, scale=False)
        return NeighbourLearners(
            tuple(features), members, whole.table, key, label, whole.k, whole.metric, whole.weights
        )
    if kind in ("dct", "xgb"):
        edges, tables = binned.fit_tables(train, label, features, members, kind, settings)
        return BinnedLearners(tuple(features), members, edges, tables)
    raise ValueError(f"unknown weak learner {kind!r}")


def ensemble_probability(raw: Column) -> Column:
    """(raw + 1) / 2, kept within 0 and 1."""
    return F.when(raw < -1, 0.0).when(raw > 1, 1.0).otherwise((raw + 1.0) / 2.0)


@dataclass(frozen=True)
class EnsembleModel:
    learners: Any
    weights: np.ndarray
    timing: dict[str, float]
    #: 0/1 weights whose proof was asked for: how much less energy another choice could have at most.
    gap: float | None = None

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.learners.raw_score(df, self.weights, "raw_score")
        raw = F.col("raw_score")
        return (
            scored.withColumn("probability", ensemble_probability(raw))
            .withColumn("prediction", F.when(raw > 0, 1).otherwise(-1))
            .drop("raw_score")
        )

    def parameters(self) -> list[tuple[str, str, float]]:
        names = self.learners.features
        rows = []
        for i, members in enumerate(self.learners.members):
            which = "+".join(names[j] for j in members)
            rows.append(("learner_weight", which, float(self.weights[i])))
            if isinstance(self.learners, SquareLearners):
                rows.append(("learner_bias", which, float(self.learners.bias[i])))
                for j in members:
                    rows.append((f"learner_slope:{names[j]}", which,
                                 float(self.learners.slope[i, j])))
                    rows.append((f"learner_square:{names[j]}", which,
                                 float(self.learners.square[i, j])))
        return rows


def fit(
    train: DataFrame, key: str, label: str, features: Sequence[str], settings: Mapping[str, Any],
    binary: bool = False,
) -> EnsembleModel:
    import time

    s = take_settings(settings, {**DEFAULTS, **PROVE}, UNUSED)
    began = time.perf_counter()
    learners = fit_learners(
        train, key, label, features, s["weak_cls_type"], int(s["weak_cls_schedule"]),
        s["weak_cls_params"] or {},
    )
    source = learners.source(train, label)
    if binary:
        j, c = quadratic_terms(source, float(s["lambda_coef"]))
    built = time.perf_counter()
    gap = None
    if binary:
        weights, gap = solve_binary(train.sparkSession, j, c, bool(s["prove"]))
    else:
        weights, _ = bounded_weights(source, float(s["lambda_coef"]))
    timing = {"solve": time.perf_counter() - built, "get_hamiltonian": built - began}
    return EnsembleModel(learners, weights, timing, gap)
