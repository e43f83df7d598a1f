"""Neighbours, oversampling and estimators against brute force and known properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarelane.estimators import boosted, choices, discriminant, ensemble, fit_model, gram, knn, newton, trees
from rarelane.estimators.moments import class_moments
from rarelane.operators import neighbours, oversample
from rarelane.operators.neighbours import Metric, nearest, nearest_lists
from rarelane.operators.scale import fit_scaler
from rarelane.sources.models import load_model, save_model

FEATURES = ["V0", "V1", "V2", "V3"]


@pytest.fixture(scope="module")
def cloud(spark):
    """600 rows, four features (one coarse, so distances tie), a third are copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    x[:, 3] = np.round(x[:, 3])
    x[400:] = x[7]
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=600) > 0.8).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(600)]
    schema = "k bigint, y int, " + ", ".join(f"{f} double" for f in FEATURES)
    df = spark.createDataFrame(rows, schema).repartition(5).persist()
    return df, x, y


def brute(a, b, k, p, own=None):
    d = Metric(p).between(a, b)
    if own is not None:
        d[np.arange(len(a)), own] = np.inf
    return [list(np.lexsort((np.arange(len(b)), row))[:k]) for row in d]


FINE = {"cell_rows": 150, "block_rows": 30, "slice_rows": 50}


@pytest.mark.parametrize("p,cut", [
    (2.0, {}), (2.0, {"cell_rows": 40}), (2.0, FINE), (1.0, FINE), (3.0, FINE), (math.inf, FINE),
])
def test_neighbours_match_brute_force(cloud, p, cut):
    df, x, _ = cloud
    views = [["V0"], ["V3"], ["V0", "V1"], FEATURES]
    at = [[0], [3], [0, 1], [0, 1, 2, 3]]
    found = nearest_lists(df, df, "k", views, 6, Metric(p), skip_self=True, **cut).toPandas()
    for v, columns in enumerate(at):
        want = brute(x[:, columns], x[:, columns], 6, p, np.arange(600))
        got = found[found["view"] == v].set_index("k")["near"]
        assert all([n["base_key"] for n in got[i]] == want[i] for i in range(600))


def test_zero_distance_and_weights(spark):
    base = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0), (3, 0, 2.0)], "k int, y int, V0 double")
    ask = spark.createDataFrame([(9, 0.0), (8, 0.5)], "k int, V0 double")
    model = knn.fit(base, "k", "y", ["V0"], {"n_neighbors": 3}, scale=False)
    got = {r["k"]: r["probability"] for r in model.score(ask).collect()}
    assert got[9] == 1.0
    assert got[8] == pytest.approx((1 / 0.5) / (1 / 0.5 + 1 / 0.5 + 1 / 1.5))
    uniform = knn.fit(base, "k", "y", ["V0"], {"n_neighbors": 3, "weights": "uniform"}, scale=False)
    assert {round(r["probability"], 6) for r in uniform.score(ask).collect()} == {0.333333}


def test_train_rows_find_themselves(cloud):
    df, _, _ = cloud
    model = fit_model("knn", df.where("k < 400"), "k", "y", FEATURES)
    wrong = model.score(df.where("k < 400")).where("(y = 1) <> (prediction = 1)").count()
    assert wrong == 0


def test_index_settings_do_not_matter(cloud):
    df, _, _ = cloud
    some = [
        fit_model("knn", df, "k", "y", FEATURES, {"algorithm": a, "leaf_size": n})
        .score(df).orderBy("k").select("probability").toPandas()
        for a, n in (("ball_tree", 5), ("brute", 60))
    ]
    assert some[0].equals(some[1])


# ---- oversampling ---------------------------------------------------------


@pytest.mark.parametrize("line_rows, skip", [(50_000, True), (7, True), (40, False), (1, False)])
def test_lines_against_brute_force(spark, monkeypatch, line_rows, skip):
    """Single features with ties, copies, gaps and asked values beyond all others, in parts of a few values."""
    monkeypatch.setattr(neighbours, "LINE_ROWS", line_rows)
    rng = np.random.default_rng(line_rows)
    x = np.round(rng.normal(size=(300, 2)) * [3, 40])
    x[200:260] = x[5]
    base = spark.createDataFrame([(i, i % 3, *map(float, v)) for i, v in enumerate(x)], "k bigint, y int, a double, b double").repartition(6)
    asked, ask = x, base
    if not skip:
        asked = np.concatenate([x[:50], [[-1e6, 1e6], [0.5, 0.5]]])
        rows = [(1000 + i, *map(float, v)) for i, v in enumerate(asked)] + [(2000, None, float("nan"))]
        ask = spark.createDataFrame(rows, "k bigint, a double, b double").repartition(4)
    views = [["a"], ["a", "b"], ["b"]]
    found = nearest_lists(ask, base, "k", views, 6, skip_self=skip, carry=["y"], with_vectors=True).toPandas()
    for view, columns in enumerate([[0], [0, 1], [1]]):
        want = brute(asked[:, columns], x[:, columns], 6, 2.0, np.arange(300) if skip else None)
        own = found[(found["view"] == view) & (found["k"] != 2000)].sort_values("k")
        assert [[r["base_key"] for r in n] for n in own["near"]] == want
        for row, ids in zip(own["near"], want):
            assert [r["y"] for r in row] == [i % 3 for i in ids]
            assert [list(r["base_vector"]) for r in row] == x[ids][:, columns].tolist()
    if not skip:
        assert all(len(n) == 0 for n in found[(found["k"] == 2000) & (found["view"] != 1)]["near"])


def test_smote_counts_and_segments(cloud):
    df, x, y = cloud
    small = min((0, 1), key=lambda c: (y == c).sum())
    made = oversample.smote_rows(df, "y", "k", FEATURES, 1.0, 42).collect()
    assert len(made) == abs((y == 0).sum() - (y == 1).sum())
    for r in made[:50]:
        a, b = x[r["base_key"]], x[r["mate_key"]]
        point = np.array([r[f] for f in FEATURES])
        gap = np.abs(point - a).sum() / max(np.abs(b - a).sum(), 1e-300)
        assert y[r["base_key"]] == y[r["mate_key"]] == small
        assert np.allclose(point, a + gap * (b - a)) and 0 <= gap < 1


def test_smote_lists_hold_no_vectors(spark, monkeypatch):
    """Lists of neighbours carry a row number, not all features; repeated keys still find their own rows."""
    kinds, every = [], oversample.nearest_lists
    monkeypatch.setattr(oversample, "nearest_lists", lambda *a, **b: kinds.append(every(*a, **b)) or kinds[-1])
    rows = [(i // 2 if i < 40 else i, int(i < 40), float(i // 2), float(i % 7)) for i in range(140)]
    df = spark.createDataFrame(rows, "k int, y int, V0 double, V1 double").repartition(5)
    made = oversample.smote_rows(df, "y", "k", ["V0", "V1"], 1.0, 42).collect()
    assert len(made) == 60
    assert "base_vector" not in kinds[0].schema["near"].dataType.elementType.names
    assert all(0 <= r["V0"] <= 19 and 0 <= r["V1"] <= 6 for r in made)


def test_first_copies_orders_only_crowded_vectors(spark):
    rows = [(0, i, [float(i), 1.0]) for i in range(200)]
    base = spark.createDataFrame(rows, "view int, key int, vector array<double>")
    kept = neighbours._first_copies(base, 3)
    assert kept.count() == 200
    assert "Window" not in kept._jdf.queryExecution().toString()
    more = [(v, 1000 + i, x) for i in range(9) for v, x in ((0, [5.0, 1.0]), (1, [5.0, 1.0]), (0, [float("nan"), -1.0]))]
    kept = neighbours._first_copies(base.union(spark.createDataFrame(more, base.schema)), 3).toPandas()
    assert kept.columns.tolist() == ["view", "key", "vector"]
    assert sorted(kept["key"][(kept["view"] == 0) & (kept["key"] >= 1000)]) == [1000, 1000, 1001, 1001, 1002]
    assert sorted(kept["key"][kept["view"] == 1]) == [1000, 1001, 1002]
    assert (kept["key"] < 1000).sum() == 200


def test_ratio_half():
    assert oversample.rows_to_add(344, 3500, 0.5) == 1406
    with pytest.raises(ValueError, match="fewer"):
        oversample.rows_to_add(400, 500, 0.5)


def test_too_few_minority_rows(spark):
    rows = [(i, int(i < 5), float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, y int, V0 double")
    with pytest.raises(ValueError, match="6 minority rows"):
        oversample.smote_rows(df, "y", "k", ["V0"], 1.0, 1)


def test_dense_index_is_dense(cloud):
    df, _, _ = cloud
    numbered = oversample.dense_index(df.select("k"), ["k"], 42, "i").select("i").toPandas()["i"]
    assert sorted(numbered) == list(range(600))


def test_adasyn_follows_hard_rows(cloud):
    df, x, y = cloud
    made = oversample.adasyn_rows(df, "y", "k", FEATURES, 1.0, 42)
    small = min((0, 1), key=lambda c: (y == c).sum())
    pool = np.nonzero(y == small)[0]
    near = brute(x[pool], x, 5, 2.0, pool)
    share = np.array([np.mean(y[n] != small) for n in near])
    want = np.rint(share / share.sum() * abs((y == 0).sum() - (y == 1).sum())).astype(int)
    got = {r["base_key"]: r["count"] for r in made.groupBy("base_key").count().collect()}
    assert got == {int(k): int(n) for k, n in zip(pool, want) if n}


def test_oversampled_keys_are_unique(cloud):
    df, _, _ = cloud
    whole = oversample.oversample(df, "y", "k", FEATURES, "random", 1.0, 42)
    assert whole.count() == whole.select("k").distinct().count()


# ---- estimators -----------------------------------------------------------


def test_moments_both_ways(cloud):
    df, x, y = cloud
    got = class_moments(df, "y", FEATURES)
    from rarelane.estimators import moments

    wide = moments._sums_by_batch(df, "y", FEATURES).toPandas().sort_values(["label", "i", "j"])
    narrow = moments._sums_by_aggregate(df, "y", FEATURES).toPandas().sort_values(["label", "i", "j"])
    assert np.allclose(wide["total"], narrow["total"])
    for c in (0, 1):
        assert np.allclose(got.covariances[c], np.cov(x[y == c].T, bias=True))
        assert np.allclose(got.means[c], x[y == c].mean(axis=0))


def _ledoit_wolf(z):
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    gap = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / p, gap)
    return (1 - noise / gap) * s + noise / gap * mu * np.eye(p)


@pytest.mark.parametrize("shrinkage", [None, 0.9, "auto"])
def test_discriminant_against_numpy(cloud, shrinkage):
    df, x, y = cloud
    model = fit_model("lda", df, "k", "y", FEATURES, {"shrinkage": shrinkage})
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cov, means, priors = np.zeros((4, 4)), [], []
    for c in (0, 1):
        part = z[y == c]
        means.append(part.mean(axis=0))
        priors.append(len(part) / len(z))
        s = np.cov(part.T, bias=True)
        if shrinkage == "auto":
            scale = part.std(axis=0)
            s = _ledoit_wolf((part - means[c]) / scale) * np.outer(scale, scale)
        elif shrinkage:
            s = discriminant.shrink(s, shrinkage)
        cov += priors[c] * s
    w = np.linalg.solve(cov, means[1] - means[0])
    b = -0.5 * (means[0] + means[1]) @ w + np.log(priors[1] / priors[0])
    want = 1 / (1 + np.exp(-(z @ w + b)))
    got = model.score(df).orderBy("k").toPandas()["probability"]
    assert np.allclose(got, want)


def test_discriminant_singular_and_solvers(cloud):
    df, _, _ = cloud
    twice = df.withColumn("V4", F.col("V0") * 4 + F.col("V1") * 4)
    names = [*FEATURES, "V4"]
    got = [
        fit_model("lda", twice, "k", "y", names, {"shrinkage": None, "solver": s})
        .score(twice).orderBy("k").toPandas()["probability"].to_numpy()
        for s in ("lsqr", "eigen", "svd")
    ]
    assert np.allclose(got[0], got[1]) and np.abs(got[0] - got[2]).max() < 0.01
    with pytest.raises(ValueError, match="shrinkage"):
        fit_model("lda", df, "k", "y", FEATURES, {"shrinkage": 0.1, "solver": "svd"})


def test_logistic_gradient_vanishes(cloud):
    df, x, y = cloud
    model = fit_model("logistic_regression", df, "k", "y", FEATURES, {"C": 0.5, "tol": 1e-8})
    scaler = fit_scaler(df, FEATURES, "standard")
    z = (x - np.array(scaler.offset)) / np.array(scaler.divisor)
    w = np.array(model.weights) * np.array(scaler.divisor)
    b = model.bias + np.array(model.weights) @ np.array(scaler.offset)
    weight = np.where(y == 1, 600 / (2 * y.sum()), 600 / (2 * (600 - y.sum())))
    error = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
    assert np.abs(w + 0.5 * z.T @ error).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_balanced_weights_are_void_at_one_to_one(cloud):
    df, _, y = cloud
    n = int(min((y == 0).sum(), (y == 1).sum()))
    even = df.where("y = 0").orderBy("k").limit(n).union(df.where("y = 1").orderBy("k").limit(n))
    even = even.persist()
    a, b = (
        fit_model("logistic_regression", even, "k", "y", FEATURES, {"class_weight": w})
        for w in ("balanced", None)
    )
    assert np.allclose(a.weights, b.weights, atol=1e-5)


def test_naive_bayes_against_numpy(cloud):
    df, x, y = cloud
    got = fit_model("naive_bayes", df, "k", "y", FEATURES).score(df).orderBy("k").toPandas()
    like = []
    for c in (0, 1):
        part = x[y == c]
        var = part.var(axis=0) + 1e-9 * x.var(axis=0).max()
        like.append(np.log(len(part)) - 0.5 * (np.log(var) + (x - part.mean(axis=0)) ** 2 / var).sum(axis=1))
    assert np.allclose(got["probability"], 1 / (1 + np.exp(like[0] - like[1])))


@pytest.mark.parametrize("algorithm", ["xgboost", "decision_tree"])
def test_trees_learn(cloud, algorithm):
    df, _, _ = cloud
    settings = {"n_estimators": 5, "max_depth": 3, "min_child_weight": 1, "reg_lambda": 2.0}
    scored = fit_model(algorithm, df, "k", "y", FEATURES, settings).score(df)
    assert scored.where("(y = 1) = (prediction = 1)").count() > 420
    assert set(scored.columns) == set(df.columns) | {"probability", "prediction"}


def _plain_boosting(x, y, s):
    """Exact greedy boosting over all cuts, without draws; margins of the rows."""
    margin = np.zeros(len(y))

    def worth(g, h):
        return max(abs(g) - s["reg_alpha"], 0.0) ** 2 / (h + s["reg_lambda"])

    def grow(rows, g, h, depth):
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                gl, hl, gt, ht = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                if min(hl, ht - hl) < s["min_child_weight"]:
                    continue
                gain = worth(gl, hl) + worth(gt - gl, ht - hl) - worth(gt, ht)
                if gain > 1e-6 and gain >= s["gamma"] and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, np.setdiff1d(rows, left))
        if best is None or depth == 0:
            gt, ht = g[rows].sum(), h[rows].sum()
            step = np.sign(gt) * max(abs(gt) - s["reg_alpha"], 0.0) / (ht + s["reg_lambda"])
            margin[rows] -= s["learning_rate"] * step if ht >= s["min_child_weight"] else 0.0
            return
        grow(best[1], g, h, depth - 1)
        grow(best[2], g, h, depth - 1)

    for _ in range(s["n_estimators"]):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), p - y, p * (1 - p), s["max_depth"])
    return margin


@pytest.mark.parametrize("change", [
    {}, {"reg_lambda": 30.0}, {"reg_alpha": 9.0}, {"gamma": 8.0}, {"min_child_weight": 25}, {"max_depth": 5},
])
def test_boosting_against_a_plain_search(cloud, monkeypatch, change):
    df, x, y = cloud
    monkeypatch.setattr(boosted, "HELD", 2)
    monkeypatch.setattr(boosted, "DENSE_CELLS", 4000)
    s = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3, "min_child_weight": 3, "reg_lambda": 1.0, "reg_alpha": 0.5,
         "gamma": 0.1, "subsample": 1.0, "colsample_bytree": 1.0, "max_bin": 65536, "random_state": 1, **change}
    want = 1 / (1 + np.exp(-_plain_boosting(x, y, s)))
    rounded = {**s, "max_bin": 4000}
    got = fit_model("xgboost", df, "k", "y", FEATURES, rounded).score(df).orderBy("k").toPandas()["probability"]
    assert np.allclose(got, want, atol=1e-9)


def test_boosting_ends_when_nothing_can_change(cloud):
    df, _, _ = cloud
    s = {"n_estimators": 500, "min_child_weight": 1000, "subsample": 1.0, "colsample_bytree": 1.0}
    model = fit_model("xgboost", df, "k", "y", FEATURES, s)
    assert len(model.trees) == 1
    assert model.score(df).where("probability = 0.5 AND prediction = -1").count() == df.count()


def test_boosted_shares_and_missing_values(spark, cloud, tmp_path):
    df, x, _ = cloud
    s = {"n_estimators": 4, "max_depth": 2, "min_child_weight": 1, "subsample": 0.6, "colsample_bytree": 0.5, "max_bin": 16}
    model = fit_model("xgboost", df.repartition(5), "k", "y", FEATURES, s)
    again = fit_model("xgboost", df.coalesce(1), "k", "y", FEATURES, s)
    assert [t.feature for t in model.trees] == [t.feature for t in again.trees]
    assert all(np.allclose(a.value, b.value) for a, b in zip(model.trees, again.trees))
    assert max(len({f for f in t.feature if f >= 0}) for t in model.trees) <= max(1, len(FEATURES) // 2)
    save_model(spark, model, str(tmp_path / "m"))
    assert load_model(spark, str(tmp_path / "m")) == model
    hole = df.limit(3).withColumn(FEATURES[0], F.lit(None).cast("double"))
    assert model.score(hole).where("probability IS NULL AND prediction IS NULL").count() == 3
    with pytest.raises(Exception, match="missing values"):
        fit_model("xgboost", df.withColumn(FEATURES[0], F.when(F.col("k") > 3, F.col(FEATURES[0]))), "k", "y", FEATURES, s)


# ---- the vote ensemble ----------------------------------------------------


def test_schedule_sizes():
    names = [f"f{i}" for i in range(38)]
    assert [len(ensemble.subsets(names, s)) for s in (1, 2, 3)] == [38, 741, 9177]


def test_logistic_learners_against_newton(cloud):
    df, x, y = cloud
    got = ensemble.fit_learners(df, "k", "y", FEATURES, "lg", 2, {"C": 10})
    for n, members in enumerate(got.members):
        a = np.column_stack([x[:, list(members)], np.ones(600)])
        t = np.zeros(a.shape[1])
        reg = np.diag([0.1] * len(members) + [0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-a @ t))
            t -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + reg, a.T @ (p - y) + reg @ t)
        assert np.allclose(got.slope[n, list(members)], t[:-1], atol=1e-4)
        assert np.isclose(got.bias[n], t[-1], atol=1e-4)


@pytest.mark.parametrize("kind", ["lda", "nb", "lg", "knn", "dct", "xgb"])
def test_gram_equals_votes(cloud, kind):
    df, _, y = cloud
    settings = {"max_depth": 3, "n_estimators": 10} if kind in ("dct", "xgb") else {}
    learners = ensemble.fit_learners(df, "k", "y", FEATURES, kind, 2, settings)
    h = np.stack(learners.votes(df).orderBy("k").toPandas()["votes"].to_numpy()).astype(float)
    j, c = ensemble.quadratic_terms(learners.source(df, "y"), 0.5)
    assert np.allclose(j, h.T @ h + 0.5 * np.eye(h.shape[1]))
    assert np.allclose(c, -2 * h.T @ (2 * y - 1))
    table = learners.gram(df, "y").toPandas()
    every = np.column_stack([h, 2 * y - 1])
    assert np.array_equal((every.T @ every)[table["i"], table["j"]], table["total"])
    assert len(table) == every.shape[1] * (every.shape[1] + 1) // 2
    w, _ = gram.bounded_weights(learners.source(df, "y"), 0.5)
    assert gram.kkt_residual(j, c, w, 1.0) < 1e-5
    raw = learners.raw_score(df, w, "raw").orderBy("k").toPandas()["raw"]
    assert np.allclose(raw, h @ w)


def _best_stump(values, y):
    """Lowest Gini split of one feature, tried at every value."""
    def impurity(part):
        return 2 * part.sum() * (len(part) - part.sum()) / max(len(part), 1)

    options = [(impurity(y[values <= v]) + impurity(y[values > v]), v)
               for v in np.unique(values)[:-1]]
    return min(options)[1]


def test_stumps_find_the_best_split(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, size=(500, 2)).astype(float)
    y = ((x[:, 0] > 22) ^ (rng.random(500) < 0.1)).astype(int)
    rows = [(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    learners = ensemble.fit_learners(df, "k", "y", ["a", "b"], "dct", 1, {"max_depth": 1})
    got = np.stack(learners.votes(df).orderBy("k").toPandas()["votes"].to_numpy())
    for j in range(2):
        v = _best_stump(x[:, j], y)
        left = 1 if y[x[:, j] <= v].mean() > 0.5 else -1
        right = 1 if y[x[:, j] > v].mean() > 0.5 else -1
        assert (got[:, j] == np.where(x[:, j] <= v, left, right)).all()


def test_boosting_one_round_by_hand():
    from rarelane.estimators import binned

    coords = np.array([[0], [1], [2]])
    n0, n1 = np.array([8.0, 4.0, 0.0]), np.array([2.0, 4.0, 6.0])
    settings = {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.5}
    got = binned.boost_cells(coords, coords, 3, n0, n1, settings, 0)
    # Even classes: p = 1/2, so G = (n0 - n1) / 2 and H = (n0 + n1) / 4.
    # Cut after the first bin: 3^2/3.5 + 3^2/4.5; after the second: 3^2/5.5 + 3^2/2.5 (larger).
    low, high = -0.5 * 3 / (4.5 + 1), 0.5 * 3 / (1.5 + 1)
    assert np.allclose(got, [low, low, high])


def test_pair_trees_learn_an_interaction(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    learners = ensemble.fit_learners(df, "k", "y", ["a", "b"], "xgb", 2, {"n_estimators": 20})
    votes = np.stack(learners.votes(df).orderBy("k").toPandas()["votes"].to_numpy())
    right = (votes == (2 * y - 1)[:, None]).mean(axis=0)
    assert right[2] > 0.95 > 0.8 > right[0]


def test_many_learners_scored_in_batches(cloud, monkeypatch):
    df, _, _ = cloud
    learners = ensemble.fit_learners(df, "k", "y", FEATURES, "nb", 3, {})
    w = np.linspace(0.1, 1, len(learners.members))
    one = learners.raw_score(df, w, "raw").orderBy("k").toPandas()["raw"]
    monkeypatch.setattr(ensemble, "SQL_LEARNERS", 2)
    two = learners.raw_score(df, w, "raw").orderBy("k").toPandas()["raw"]
    assert np.allclose(one, two)


def test_blocks_and_working_sets(spark, monkeypatch):
    """Small blocks and sets give the weights that all learners at once give."""
    rng = np.random.default_rng(2)
    h = np.sign(rng.normal(size=(300, 40)) + rng.normal(size=(300, 1))).astype(int)
    y = (h[:, :7].sum(axis=1) + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, h)], "y int, votes array<int>").repartition(4)
    source = ensemble.vote_source(df, "y", 40)
    j, c = ensemble.quadratic_terms(source, 0.5)
    assert np.array_equal(j, h.T @ h + 0.5 * np.eye(40))
    want = gram.solve_box(j, c)
    monkeypatch.setattr(gram, "SIDE", 7)
    monkeypatch.setattr(gram, "WORKING", 9)
    monkeypatch.setattr(gram, "HELD_CELLS", 200)
    assert np.array_equal(ensemble.quadratic_terms(source, 0.5)[0], j)
    got, residual = gram.bounded_weights(source, 0.5)
    assert np.allclose(got, want, atol=1e-3) and residual.max() <= gram.ROUND_TOLERANCE
    monkeypatch.setattr(gram, "ROUNDS", 1)
    with pytest.raises(ArithmeticError, match="rounds"):
        gram.bounded_weights(source, 0.5)


def test_weights_of_9177_learners(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 38))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.5).astype(int)
    names = [f"f{i}" for i in range(38)]
    df = spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], ["k", "y", *names]).repartition(4)
    learners = ensemble.fit_learners(df, "k", "y", names, "nb", 3, {})
    source = learners.source(df, "y")
    assert source.learners == 9177
    w, residual = gram.bounded_weights(source, 1.0)
    h = learners.matrix(x)
    slope = 2 * (h.T @ (h @ w) + w) - 2 * h.T @ (2 * y - 1)
    assert np.abs(w - np.clip(w - slope / 801, 0, 1)).max() < 2e-6 and w.min() >= 0 and w.max() <= 1


def test_rows_that_voted_in_the_fit_are_scored_without_another_join(cloud, monkeypatch):
    df, _, _ = cloud
    joins, every = [], ensemble.nearest_lists
    monkeypatch.setattr(ensemble, "nearest_lists", lambda *a, **b: joins.append(1) or every(*a, **b))
    settings = {"weak_cls_type": "knn", "weak_cls_schedule": 1, "weak_cls_params": {"n_neighbors": 5}}
    model = ensemble.fit(df, "k", "y", ["V0", "V1"], settings)
    again = model.score(df)
    assert len(joins) == 1
    afresh = model.score(df.select("*")).select(again.columns)
    assert len(joins) == 2
    assert np.allclose(*(x.orderBy("k").select("k", "y", "V0", "probability", "prediction").toPandas() for x in (again, afresh)))


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0, math.inf])
def test_a_coarse_pass_and_boxes_lose_no_neighbour(p, monkeypatch):
    rng = np.random.default_rng(11)
    for width, rows in ((24, 900), (2, 12_000)):
        holds = rng.random((rows, width)) + 1000.0
        holds[50:80] = holds[7]
        holds[200:260, 0] += 1e-6
        asks, own = holds[:300], np.where(np.arange(300) % 2, np.arange(300), -1)
        every = Metric(p).between
        most = []
        monkeypatch.setattr(Metric, "between", lambda self, a, b: most.append(len(a) * len(b)) or every(a, b))
        got = {}
        for at, picked, near in neighbours._within_reach(asks, holds, own, np.full(300, np.inf), 6, Metric(p)):
            got |= dict(zip(at.tolist(), zip(picked.tolist(), near.tolist())))
        monkeypatch.undo()
        assert sum(most) < 300 * rows // 2  # exact distances are taken of some pairs only
        distance = every(asks, holds)
        distance[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
        for i in range(300):
            order = np.lexsort((np.arange(rows), distance[i]))[:6]
            assert got[i] == (order.tolist(), distance[i][order].tolist())


def test_a_coarse_pass_turns_a_block_once(monkeypatch):
    points = np.random.default_rng(4).random((900, 24))
    turned, turn = [], np.ascontiguousarray
    monkeypatch.setattr(np, "ascontiguousarray", lambda x: turned.append(x.shape) or turn(x))
    parts = list(neighbours._all_nearest(points, points, np.arange(900), 6, Metric(1.0)))
    assert len(parts) > 10 and len(turned) == 1


def test_what_is_wanted_of_a_list_is_written_in_its_place(spark, monkeypatch):
    """Votes instead of lists, for all rows that no further cell can change; the same as votes taken at the end."""
    kept, stage = {}, neighbours.stage_table
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.random() < 0.4), *map(float, rng.normal(size=2).round(2))) for i in range(1_500)]
    base = spark.createDataFrame(rows, "k bigint, y int, a double, b double").repartition(4)
    odd = [(9_000, None, 0.5), (9_001, 0.5, float("nan")), (9_002, 50.0, 50.0), (9_003, None, None)]
    ask = base.select("k", "a", "b").unionByName(spark.createDataFrame(odd, "k bigint, a double, b double"))
    views = [["a"], ["a", "b"], ["b"]]

    def voted(near):
        return F.when(knn.vote(near, "y", "uniform") > 0.5, 1).otherwise(-1)

    late = nearest_lists(ask, base, "k", views, 5, carry=["y"], cell_rows=300)
    late = late.select("view", "k", voted(F.col("near")).alias("near"))
    monkeypatch.setattr(neighbours, "stage_table", lambda df, name: kept.setdefault(name, stage(df, name)))
    early = nearest_lists(ask, base, "k", views, 5, carry=["y"], cell_rows=300, fold=voted)
    monkeypatch.undo()
    assert early.schema["near"].dataType.simpleString() == "int" == kept["line_lists"].schema["near"].dataType.simpleString()
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect())) and early.count() == 3 * 1_504
    lists, every = kept["first"].where("near IS NOT NULL"), kept["first"].count()
    assert every == 1_504 and lists.count() < 0.5 * every
    assert lists.where("answer IS NOT NULL OR size(visits) = 0").isEmpty()
    assert kept["first"].where("near IS NULL AND (answer IS NULL OR vector IS NOT NULL)").isEmpty()


def test_only_lists_of_cut_cells_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(700, 2)) * 0.1, rng.normal(size=(300, 2)) * 20.0])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k bigint, a double, b double").repartition(4)
    plans, lists = [], neighbours._Comparison.lists
    monkeypatch.setattr(neighbours._Comparison, "lists", lambda self, a, s, plan, keep=(): plans.append(plan) or lists(self, a, s, plan, keep))
    found = nearest_lists(df, df, "k", [["a", "b"]], 4, cell_rows=100, block_rows=150, skip_self=True).toPandas()
    whole, cut = plans[:2]
    assert whole and cut and all(n <= 150 for _, n, _ in whole) and all(n > 150 for _, n, _ in cut)
    want = brute(x, x, 4, 2.0, np.arange(1_000))
    assert [[r["base_key"] for r in n] for n in found.sort_values("k")["near"]] == want


def near_by_sieve(asks, holds, own, bound, k, p):
    got = {}
    for at, picked, near in neighbours._within_reach(asks, holds, own, bound, k, Metric(p)):
        for i, ids, far in zip(at.tolist(), picked, near):
            within = np.isfinite(far) & (far <= bound[i])
            got[i] = (ids[within].tolist(), far[within].tolist())
    return got


@pytest.mark.parametrize("kind", ["round", "tails", "steps", "far", "same"])
@pytest.mark.parametrize("p", [1.0, 2.0, 3.0, math.inf])
def test_a_sieve_tells_the_near_rows_without_distances_of_all(p, kind, monkeypatch):
    """Rows asked from elsewhere too, outliers, ties and one value; whole lists and lists within a bound."""
    rng = np.random.default_rng(5)
    holds, asks = rng.normal(size=(3_000, 37)), rng.normal(size=(150, 37))
    if kind == "tails":
        holds, asks = np.sinh(3.0 * holds), np.sinh(3.0 * asks)
    if kind == "steps":
        holds, asks = np.rint(holds), np.rint(asks)
    if kind == "far":
        asks += 40.0
    if kind == "same":
        holds[:], asks[:75] = 2.5, 2.5
    own = np.where(np.arange(150) < 50, np.arange(150) * 60, -1)
    asks[:50] = holds[own[:50]]
    distance = Metric(p).between(asks, holds)
    distance[np.arange(50), own[:50]] = np.inf
    if kind == "round":
        monkeypatch.setattr(Metric, "coarse", None)  # nor of any in single precision
    for bound in (np.full(150, np.inf), np.sort(distance, axis=1)[:, 3], np.where(np.arange(150) % 2, np.inf, 0.5)):
        got = near_by_sieve(asks, holds, own, bound, 6, p)
        for i in range(150):
            order = np.lexsort((np.arange(3_000), distance[i]))[:6]
            order = order[distance[i][order] <= bound[i]]
            assert got[i] == (order.tolist(), distance[i][order].tolist())


def test_a_sieve_that_leaves_too_many_rows_gives_way(monkeypatch):
    rng = np.random.default_rng(6)
    holds, own = rng.normal(size=(700, 20)), np.full(90, -1)
    asked, coarse = [], neighbours._coarse_nearest
    monkeypatch.setattr(neighbours, "_coarse_nearest", lambda a, *rest: asked.append(len(a)) or coarse(a, *rest))
    whole = near_by_sieve(holds[:90], holds, own, np.full(90, np.inf), 5, 1.0)
    assert not asked
    monkeypatch.setattr(neighbours, "SIEVE_SHARE", 0.0)
    assert near_by_sieve(holds[:90], holds, own, np.full(90, np.inf), 5, 1.0) == whole and sum(asked) == 90


def test_few_cells_are_cut_into_several_groups_a_core():
    plan = [(0, 17_000, 17_000), (1, 9_000, 30_000), (2, 50_000, 300)]
    cuts = neighbours._cuts(plan, 20_000, 20_000, 12)
    assert [c for c, _, _ in cuts] == [0, 1, 2]
    share = sum(base * rows for _, base, rows in plan) / (12 * neighbours.GROUPS_PER_CORE)
    for (_, base, rows), (_, blocks, slices) in zip(plan, cuts):
        assert blocks == -(-base // 20_000) and slices <= -(-rows // 200)
        assert base / blocks * rows / slices <= share or slices == -(-rows // 200)
    # small jobs stay whole, large ones are cut by rows alone
    assert neighbours._cuts([(0, 150, 150)], 20_000, 20_000, 12) == [(0, 1, 1)]
    many = [(c, 20_000, 500_000) for c in range(100)]
    assert neighbours._cuts(many, 20_000, 20_000, 12) == [(c, 1, 25) for c in range(100)]


def test_bounded_weights_query_keeps_a_row_s_votes_in_it(spark, tmp_path):
    from rarelane.catalog.ensembles import bounded_weights

    rng = np.random.default_rng(8)
    rows = [(i // 2, [float(v) for v in rng.normal(size=64)], i % 3) for i in range(240)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = bounded_weights(spark, str(tmp_path))
    assert "vec_id" not in out._jdf.queryExecution().toString()  # nothing is joined by the key, whose rows are 741 votes long
    got = out.toPandas()
    assert len(got) == 741 and (got["residual"] == 0).all() and got["inside"].all()


def test_binary_choice_is_exact(spark):
    rng = np.random.default_rng(1)
    h = np.sign(rng.normal(size=(50, 8)))
    j, c = h.T @ h, -2 * h.T @ np.sign(rng.normal(size=50))
    patterns = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)
    energy = ((patterns @ j) * patterns).sum(axis=1) + patterns @ c
    best = ensemble.binary_choice(spark, j, c).first()
    assert best["energy"] == pytest.approx(energy.min()) and best["choice"] == energy.argmin()


@pytest.mark.parametrize("algorithm,settings", [
    ("lda", {}), ("naive_bayes", {}), ("knn", {"n_neighbors": 3}),
    ("decision_tree", {"max_depth": 3}),
    ("classical_qboost", {"weak_cls_type": "nb", "weak_cls_schedule": 2}),
    ("classical_qboost", {"weak_cls_type": "knn"}),
    ("classical_qboost", {"weak_cls_type": "xgb", "weak_cls_params": {"n_estimators": 5}}), ("qiskit", {"weak_cls_type": "lg"}),
])
def test_saved_models_score_the_same(spark, cloud, tmp_path, algorithm, settings):
    df, _, _ = cloud
    model = fit_model(algorithm, df, "k", "y", FEATURES, settings)
    save_model(spark, model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    one, two = (
        m.score(df).orderBy("k").select("probability", "prediction").toPandas() for m in (model, back)
    )
    assert np.allclose(one["probability"], two["probability"]) and (one["prediction"] == two["prediction"]).all()


def test_unknown_names(cloud):
    df, _, _ = cloud
    with pytest.raises(ValueError, match="unknown algorithm"):
        fit_model("svm", df, "k", "y", FEATURES)
    with pytest.raises(ValueError, match="unknown distance"):
        Metric.named("cosine")
    with pytest.raises(ValueError, match="unknown weak learner"):
        ensemble.fit_learners(df, "k", "y", FEATURES, "svm", 1, {})


def test_explicit_ranks(cloud):
    df, _, _ = cloud
    found = nearest(df, df, "k", FEATURES, 3, carry=["y"])
    assert found.columns == ["k", "rank", "distance", "base_key", "y"] and found.count() == 1800


def test_proof_against_all_choices(spark, monkeypatch):
    monkeypatch.setattr(choices, "CASES", 7)  # many rounds
    monkeypatch.setattr(choices, "ROUNDS", 60)
    rng = np.random.default_rng(4)
    for rows in (6, 40):  # fewer rows than learners: singular products
        h = np.sign(rng.normal(size=(rows, 9)) + 0.7 * rng.normal(size=(rows, 1)))
        j, c = h.T @ h, -2 * h.T @ np.sign(rng.normal(size=rows))
        patterns = ((np.arange(512)[:, None] >> np.arange(9)) & 1).astype(float)
        energy = ((patterns @ j) * patterns).sum(axis=1) + patterns @ c
        row = choices.proven_choice(spark, j, c, np.zeros(9)).first()
        assert row["gap"] == 0.0 and row["energy"] == pytest.approx(energy.min())
        x = np.array(row["bits"], float)
        assert x @ j @ x + c @ x == pytest.approx(energy.min())
    monkeypatch.setattr(choices, "ROUNDS", 1)
    row = choices.proven_choice(spark, j, c, np.zeros(9)).first()
    assert row["energy"] - row["gap"] <= energy.min() + 1e-6


def test_binary_weights_let_all_learners_compete(spark):
    rng = np.random.default_rng(8)
    h = np.sign(rng.normal(size=(400, 38)))
    j, c = h.T @ h, -2 * h.T @ h[:, 30]
    x, gap = ensemble.solve_binary(spark, j, c, proof=True)
    assert gap == 0.0
    energy = lambda v: v @ j @ v + c @ v
    for i in range(38):
        near = x.copy()
        near[i] = 1 - near[i]
        assert energy(near) >= energy(x) - 1e-6
    assert x[30] == 1


def test_solver_raises_without_convergence(monkeypatch):
    rng = np.random.default_rng(3)
    h = rng.normal(size=(30, 6))
    monkeypatch.setattr(gram, "SOLVE_STEPS", 1)
    with pytest.raises(ArithmeticError, match="residual"):
        gram.solve_box(h.T @ h, -h.T @ rng.normal(size=30))


def test_logistic_learners_take_their_settings(cloud):
    df, _, _ = cloud
    plain = ensemble.fit_learners(df, "k", "y", FEATURES, "lg", 1, {})
    heavy = ensemble.fit_learners(df, "k", "y", FEATURES, "lg", 1, {"class_weight": {0: 1.0, 1: 5.0}})
    assert (heavy.bias > plain.bias).all()
    with pytest.raises(ValueError, match="l1_ratio"):
        ensemble.fit_learners(df, "k", "y", FEATURES, "lg", 1, {"penalty": "elasticnet"})
    with pytest.raises(ValueError, match="penalty"):
        ensemble.fit_learners(df, "k", "y", FEATURES, "lg", 1, {"penalty": "l3"})


@pytest.mark.parametrize("penalty, ratio, c", [("l1", None, 0.02), ("l1", None, 5.0), ("elasticnet", 0.4, 0.02), ("none", None, 1.0)])
def test_penalised_learners_are_optimal(cloud, penalty, ratio, c):
    df, x, y = cloud
    settings = {"penalty": penalty, "C": c, "l1_ratio": ratio, "tol": 1e-9}
    got = ensemble.fit_learners(df, "k", "y", FEATURES, "lg", 3, settings)
    share = {"l1": 1.0, "elasticnet": ratio, "none": 0.0}[penalty]
    l1, l2 = (0.0, 0.0) if penalty == "none" else (share / c, (1 - share) / c)
    zeros = 0
    for n, members in enumerate(got.members):
        w, own = got.slope[n, list(members)], x[:, list(members)]
        error = 1 / (1 + np.exp(-(own @ w + got.bias[n]))) - y
        slope = own.T @ error + l2 * w
        zeros += (w == 0).sum()
        assert abs(error.sum()) < 1e-5
        assert np.abs(slope[w != 0] + l1 * np.sign(w[w != 0])).max(initial=0.0) < 1e-5
        assert (np.abs(slope[w == 0]) <= l1 + 1e-6).all()
    assert (zeros > 0) == (penalty != "none" and c < 1)


def test_steps_that_do_not_help_are_halved(spark):
    """Newton from zero overshoots on a lone far point; the objective still falls to its least."""
    x = np.array([-1.0, -1.0, -1.0, 1.0, 60.0, 0.5])
    y = np.array([0, 0, 1, 1, 0, 1])
    df = spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, y)], "y int, a double")
    w, b = newton.fit_learners(df, "y", ["a"], [(0,)], np.ones(2), 0.0, 1e-3, 100, 1e-10)[0]
    error = 1 / (1 + np.exp(-(w * x + b))) - y
    assert abs(error.sum()) < 1e-6 and abs(error @ x + 1e-3 * w) < 1e-6


def _plain_tree(x, y, depth, least, kind):
    """Positive share of each row's leaf, by trying all cuts."""
    out = np.zeros(len(y))

    def pure(part):
        n1, n = part.sum(), len(part)
        if kind == "gini":
            return (n1 * n1 + (n - n1) ** 2) / n
        return sum(k * np.log(k / n) for k in (n1, n - n1) if k)

    def grow(rows, level):
        out[rows] = y[rows].mean()
        if 0 < y[rows].sum() < len(rows) and level != depth:
            best = None
            for f in range(x.shape[1]):
                for value in np.unique(x[rows, f])[:-1]:
                    left, right = rows[x[rows, f] <= value], rows[x[rows, f] > value]
                    if min(len(left), len(right)) >= least:
                        gain = round(pure(y[left]) + pure(y[right]), 7)
                        if best is None or gain > best[0]:
                            best = (gain, left, right)
            if best:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("depth, least, kind, part_rows", [(4, 1, "gini", 1_000_000), (None, 1, "gini", 100), (6, 9, "entropy", 37)])
def test_tree_against_a_plain_search(spark, cloud, monkeypatch, tmp_path, depth, least, kind, part_rows):
    df, x, y = cloud
    monkeypatch.setattr(trees, "PART_ROWS", part_rows)
    s = {"max_depth": depth, "min_samples_leaf": least, "criterion": kind}
    model = fit_model("decision_tree", df, "k", "y", FEATURES, s)
    got = model.score(df).orderBy("k").toPandas()["probability"]
    assert np.allclose(got, _plain_tree(x, y, depth, least, kind))
    save_model(spark, model, str(tmp_path / "m"))
    assert load_model(spark, str(tmp_path / "m")) == model


def test_tree_settings(cloud):
    df, _, _ = cloud
    with pytest.raises(ValueError, match="criterion"):
        fit_model("decision_tree", df, "k", "y", FEATURES, {"criterion": "other"})
    root = fit_model("decision_tree", df, "k", "y", FEATURES, {"max_depth": 0})
    assert len(root.tree.feature) == 1


def test_offset_features_keep_their_digits(spark):
    rows = [(i, i % 2, 1e9 + (i % 2) * 3 + ((i * 7919) % 1000) / 500.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, y int, a double")
    for name in ("lda", "naive_bayes"):
        scored = fit_model(name, df, "k", "y", ["a"], {}).score(df)
        assert scored.where("prediction <> 2 * y - 1").count() == 0
    for kind in ("lda", "nb"):
        learners = ensemble.fit_learners(df, "k", "y", ["a"], kind, 1, {})
        assert learners.votes(df).where("votes[0] <> 2 * y - 1").count() == 0
