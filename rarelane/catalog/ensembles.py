"""The vote ensemble: learners, votes, quadratic terms, weights, scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rarelane.catalog.registry import EVENTS, VECTORS, embeddings, events, query, r6
from rarelane.estimators import ensemble
from rarelane.session import stage_table

_FEATURES = ["value", "k", "u"]
_LEARNERS = ensemble.subsets(_FEATURES, 2)


def _source(spark, folder):
    return stage_table(events(spark, folder).select("event_id", "y", *_FEATURES), "events")


def _bayes_learners(src):
    return ensemble.fit_learners(src, "event_id", "y", _FEATURES, "nb", 2, {})


def _margin(members: tuple[int, ...]) -> str:
    """Log odds of one naive Bayes learner over its features."""
    floor = "greatest(" + ", ".join(f"g{i}" for i in members) + ", 0) * 1e-9"
    parts = [
        f"0.5 * (ln(a.s{i} + {floor}) - ln(b.s{i} + {floor})"
        f" + (x{i} - a.m{i}) * (x{i} - a.m{i}) / (a.s{i} + {floor})"
        f" - (x{i} - b.m{i}) * (x{i} - b.m{i}) / (b.s{i} + {floor}))"
        for i in members
    ]
    return "ln(b.n / a.n) + " + " + ".join(parts)


_STATS = ", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) AS s{i}" for i in range(3))
_WHOLE = ", ".join(f"var_pop(x{i}) AS g{i}" for i in range(3))
_VOTES = f"""
WITH {EVENTS},
x AS (SELECT event_id, y, value AS x0, k AS x1, u AS x2 FROM ev),
st AS (SELECT y, count(*) AS n, {_STATS} FROM x GROUP BY y),
gl AS (SELECT {_WHOLE} FROM x),
wide AS (SELECT event_id, x.y, [{", ".join(
    f"CASE WHEN {_margin(m)} > 0 THEN 1 ELSE -1 END" for m in _LEARNERS)}] AS h
  FROM x, st a, st b, gl WHERE a.y = 0 AND b.y = 1),
voters AS (SELECT event_id, list_concat(h, [CASE WHEN y = 1 THEN 1 ELSE -1 END]) AS h FROM wide)"""

_N = len(_LEARNERS)
_PAIRS = f"ix AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM range({_N + 1}) a(i), range({_N + 1}) b(j) WHERE i <= j)"
_GRAM = f""",
{_PAIRS},
gram AS (SELECT i, j, CAST(sum(h[i + 1] * h[j + 1]) AS DOUBLE) AS total FROM voters, ix GROUP BY 1, 2)"""
_BINARY = f""",
bits AS (SELECT c::BIGINT AS choice FROM range({1 << _N}) t(c)),
energies AS (SELECT choice, sum(CASE
    WHEN j = {_N} AND i < {_N} THEN -2 * total * ((choice >> i) & 1)
    WHEN j = {_N} THEN 0
    WHEN i = j THEN total * ((choice >> i) & 1)
    ELSE 2 * total * ((choice >> i) & 1) * ((choice >> j) & 1) END) AS energy
  FROM bits, gram GROUP BY 1),
best AS (SELECT choice, energy FROM energies ORDER BY energy, choice LIMIT 1)"""


@query("subset_schedule", _VOTES + f""",
names AS (SELECT unnest(range({_N}))::INTEGER AS learner, unnest([{", ".join(
    "'" + "+".join(_FEATURES[i] for i in m) + "'" for m in _LEARNERS)}]) AS features)
SELECT learner, features, round(avg(CASE WHEN h[learner + 1] = h[{_N + 1}] THEN 1.0 ELSE 0 END), 6) AS accuracy
FROM voters, names GROUP BY 1, 2""")
def subset_schedule(spark, folder):
    """Every learner of schedule 2 with its features and its accuracy by itself."""
    src = _source(spark, folder)
    voted = _bayes_learners(src).votes(src)
    right = F.when(F.col("y") == 1, F.col("vote") == 1).otherwise(F.col("vote") == -1)
    rates = (
        voted.select("y", F.posexplode("votes").alias("learner", "vote"))
        .groupBy("learner").agg(r6(F.avg(right.cast("double"))).alias("accuracy"))
    )
    named = ensemble.subset_table(spark, _FEATURES, 2)
    return rates.join(named, "learner").select(
        "learner", F.array_join("features", "+").alias("features"), "accuracy"
    )


@query("vote_matrix", _VOTES + f"""
SELECT event_id, l::INTEGER AS learner, h[l + 1] AS vote FROM wide, range({_N}) t(l)""")
def vote_matrix(spark, folder):
    """Votes in long form, of learners fitted in one pass."""
    src = _source(spark, folder)
    voted = _bayes_learners(src).votes(src)
    return voted.select("event_id", F.posexplode("votes").alias("learner", "vote"))


@query("gram_terms", _VOTES + _GRAM + " SELECT i, j, total FROM gram")
def gram_terms(spark, folder):
    """Summed vote products; the last voter is the label."""
    src = _source(spark, folder)
    return _bayes_learners(src).gram(src, "y")


def _terms(spark, folder):
    src = _source(spark, folder)
    learners = _bayes_learners(src)
    j, c = ensemble.quadratic_terms(learners.source(src, "y"))
    return src, learners, j, c


@query("binary_weights", _VOTES + _GRAM + _BINARY + " SELECT choice, energy FROM best")
def binary_weights(spark, folder):
    """The best of all 0/1 weightings."""
    _, _, j, c = _terms(spark, folder)
    return ensemble.binary_choice(spark, j, c)


@query("ensemble_score", _VOTES + _GRAM + _BINARY + f""",
raw AS (SELECT event_id, CAST(list_sum(list_transform(range({_N}),
          lambda l: h[l + 1] * ((choice >> l) & 1))) AS DOUBLE) AS s FROM wide, best)
SELECT event_id, least(greatest((s + 1) / 2, 0), 1) AS probability,
       CASE WHEN s > 0 THEN 1 ELSE -1 END AS prediction FROM raw""")
def ensemble_score(spark, folder):
    """Score, probability and label of the 0/1-weighted ensemble."""
    src, learners, j, c = _terms(spark, folder)
    model = ensemble.EnsembleModel(learners, ensemble.solve_binary(spark, j, c)[0], {})
    return model.score(src).select("event_id", "probability", "prediction")


# All pairs and single ones of 38 features: 741 learners.
_MANY = VECTORS[:38]
_MANY_LEARNERS = ensemble.subsets(_MANY, 2)
_MANY_VOTES = f"""
WITH x AS (SELECT vec_id, CAST(label = 1 AS INTEGER) AS y, {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(38))} FROM embeddings),
st AS (SELECT y, count(*) AS n, {", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) AS s{i}" for i in range(38))} FROM x GROUP BY y),
gl AS (SELECT {", ".join(f"var_pop(x{i}) AS g{i}" for i in range(38))} FROM x),
wide AS (SELECT x.y, [{", ".join(f"CASE WHEN {_margin(m)} > 0 THEN 1 ELSE -1 END" for m in _MANY_LEARNERS)}] AS h
  FROM x, st a, st b, gl WHERE a.y = 0 AND b.y = 1)"""


@query("bounded_weights", _MANY_VOTES + f"""
SELECT l::INTEGER AS learner, CAST(sum(h[l + 1] * CASE WHEN y = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS agreement,
       CAST(0 AS DOUBLE) AS residual, TRUE AS inside
FROM wide, range({len(_MANY_LEARNERS)}) t(l) GROUP BY 1""")
def bounded_weights(spark, folder):
    """Weights between 0 and 1 of 741 learners, held to the conditions of optimality in plain columns.

    ``residual``: how far a projected step along the slope, worked out from the votes, would move the
    weight, in steps of 1e-5: 0 for all learners.
    """
    src = stage_table(embeddings(spark, folder).select("vec_id", "y", *_MANY), "vectors")
    learners = ensemble.fit_learners(src, "vec_id", "y", _MANY, "nb", 2, {})
    w, _ = ensemble.bounded_weights(learners.source(src, "y"), 0.5)
    weights = spark.createDataFrame(list(enumerate(map(float, w))), "learner int, weight double")
    every = spark.createDataFrame([(list(map(float, w)),)], "weights array<double>")
    signed = F.when(F.col("y") == 1, 1).otherwise(-1).alias("signed")
    # a row's sum is taken inside the row: joined by the key, the long votes would be sent whole to every task
    raw = F.aggregate(F.zip_with("votes", "weights", lambda v, x: v * x), F.lit(0.0), lambda s, x: s + x).alias("raw")
    voted = stage_table(learners.votes(src).crossJoin(F.broadcast(every)).select(signed, "votes", raw), "votes")
    votes = voted.select("signed", "raw", F.posexplode("votes").alias("learner", "vote"))
    sums = votes.groupBy("learner").agg(
        F.sum(F.col("vote") * F.col("raw")).alias("product"), F.sum(F.col("vote") * F.col("signed")).alias("agreement"),
        F.count("*").alias("n"),
    )
    slope = 2 * (F.col("product") + 0.5 * F.col("weight")) - 2 * F.col("agreement")
    moved = F.least(F.greatest(F.col("weight") - slope / (F.col("n") + 0.5), F.lit(0.0)), F.lit(1.0))
    return sums.join(weights, "learner").select(
        "learner", F.col("agreement").cast("double").alias("agreement"),
        (F.round(F.abs(F.col("weight") - moved), 5) + F.lit(0.0)).alias("residual"),
        F.col("weight").between(0.0, 1.0).alias("inside"),
    )


def _scored(spark, folder, settings):
    src = _source(spark, folder)
    model = ensemble.fit(src, "event_id", "y", _FEATURES, settings)
    return model.score(src).select("event_id", "y", "probability", "prediction")


@query("ensemble_logistic")
def ensemble_logistic(spark, folder):
    return _scored(spark, folder, {"weak_cls_type": "lg", "weak_cls_schedule": 2,
                                   "weak_cls_params": {"C": 10}})


@query("ensemble_discriminant")
def ensemble_discriminant(spark, folder):
    return _scored(spark, folder, {"weak_cls_type": "lda", "weak_cls_schedule": 2,
                                   "weak_cls_params": {"solver": "lsqr", "shrinkage": "auto"}})


_PROOF = VECTORS[:14]
_PROOF_LEARNERS = ensemble.subsets(_PROOF, 1)
_PROOF_N = len(_PROOF_LEARNERS)


@query("binary_proof", _MANY_VOTES.replace(
    ", ".join(f"CASE WHEN {_margin(m)} > 0 THEN 1 ELSE -1 END" for m in _MANY_LEARNERS),
    ", ".join(f"CASE WHEN {_margin(m)} > 0 THEN 1 ELSE -1 END" for m in _PROOF_LEARNERS),
) + f""",
voters AS (SELECT list_concat(h, [CASE WHEN y = 1 THEN 1 ELSE -1 END]) AS h FROM wide),
ix AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM range({_PROOF_N + 1}) a(i), range({_PROOF_N + 1}) b(j) WHERE i <= j),
gram AS (SELECT i, j, CAST(sum(h[i + 1] * h[j + 1]) AS DOUBLE) AS total FROM voters, ix GROUP BY 1, 2)
SELECT min(energy) AS energy, CAST(0 AS DOUBLE) AS gap FROM (SELECT choice, sum(CASE
    WHEN j = {_PROOF_N} AND i < {_PROOF_N} THEN -2 * total * ((choice >> i) & 1)
    WHEN j = {_PROOF_N} THEN 0
    WHEN i = j THEN total * ((choice >> i) & 1)
    ELSE 2 * total * ((choice >> i) & 1) * ((choice >> j) & 1) END) AS energy
  FROM range({1 << _PROOF_N}) t(choice), gram GROUP BY 1)""")
def binary_proof(spark, folder):
    """The least energy of all 0/1 weightings of 14 learners, proven by branch and bound."""
    src = stage_table(embeddings(spark, folder).select("vec_id", "y", *_PROOF), "vectors")
    learners = ensemble.fit_learners(src, "vec_id", "y", _PROOF, "nb", 1, {})
    j, c = ensemble.quadratic_terms(learners.source(src, "y"))
    row = ensemble.proven_choice(spark, j, c, np.zeros(_PROOF_N))
    return row.select(F.round("energy", 6).alias("energy"), F.round("gap", 6).alias("gap"))


def _near_votes(l: int, members: tuple[int, ...]) -> str:
    """Vote of a learner: most of the 15 nearest rows, the row itself among them."""
    gap = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in members)
    return f"""SELECT a.event_id, {l} AS learner, CASE WHEN list_sum(list_transform(min(
    {{'d': sqrt({gap}), 'k': b.event_id, 'y': b.y}}, 15), lambda n: n.y)) > 7.5 THEN 1 ELSE -1 END AS vote
  FROM x a, x b GROUP BY a.event_id"""


@query("neighbour_votes", f"""
WITH {EVENTS}, x AS MATERIALIZED (SELECT event_id, y, value AS x0, k AS x1, u AS x2 FROM ev)
""" + " UNION ALL ".join(_near_votes(i, m) for i, m in enumerate(_LEARNERS)))
def neighbour_votes(spark, folder):
    """Votes of k-NN learners on single features and pairs; single ones by sorted lines."""
    src = _source(spark, folder)
    learners = ensemble.fit_learners(src, "event_id", "y", _FEATURES, "knn", 2, {"n_neighbors": 15, "weights": "uniform"})
    return learners.long_votes(src, range(len(_LEARNERS)))


@query("ensemble_neighbours")
def ensemble_neighbours(spark, folder):
    return _scored(spark, folder, {"weak_cls_type": "knn", "weak_cls_schedule": 2,
                                   "weak_cls_params": {"n_neighbors": 15, "weights": "uniform"}})


@query("ensemble_trees")
def ensemble_trees(spark, folder):
    return _scored(spark, folder, {"weak_cls_type": "dct", "weak_cls_schedule": 2,
                                   "weak_cls_params": {"max_depth": 4}})


@query("ensemble_boosted")
def ensemble_boosted(spark, folder):
    return _scored(spark, folder, {"weak_cls_type": "xgb", "weak_cls_schedule": 2,
                                   "weak_cls_params": {"n_estimators": 100, "max_depth": 3,
                                                       "learning_rate": 0.1}})
