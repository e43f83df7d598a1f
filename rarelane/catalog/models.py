"""Classifiers: neighbours, discriminant, naive Bayes, logistic, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarelane.catalog.registry import (
    EVENTS, VECTORS, embeddings, events, query, r6, split_sql,
)
from rarelane.config import DataConfig
from rarelane.estimators import discriminant, fit_model, knn, moments, newton
from rarelane.estimators.boosted import boosted_sql
from rarelane.estimators.trees import tree_sql
from rarelane.operators import evaluate, sample
from rarelane.operators.neighbours import Metric, nearest, nearest_lists
from rarelane.plans import prepare
from rarelane.session import stage_table, staging_path
from rarelane.sources.models import load_model, save_model

# ---- nearest neighbours ---------------------------------------------------

_DISTANCES = {
    "euclid": "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1]-z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1]-z[2])))",
    "minkowski3":
        "pow(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(abs(z[1]-z[2]), 3))), 1.0/3)",
}


def _near_sql(kind: str, k: int) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT * FROM (
  SELECT a.vec_id, b.vec_id AS base_key, CAST(b.label = 1 AS INTEGER) AS y, d AS distance,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS INTEGER) AS rank
  FROM e a JOIN e b ON a.vec_id <> b.vec_id, LATERAL (SELECT {_DISTANCES[kind]} AS d) x)
  WHERE rank <= {k})"""


_NEAR_COLUMNS = " SELECT vec_id, rank, base_key, round(distance, 6) AS distance FROM near"


def _voted(spark, folder, p, k, weights):
    src = embeddings(spark, folder)
    lists = nearest_lists(
        src, src, "vec_id", [VECTORS], k, Metric(p), carry=["y"], skip_self=True
    )
    return lists.select("vec_id", knn.vote(F.col("near"), "y", weights).alias("probability"))


def _near_rows(spark, folder, p):
    src = embeddings(spark, folder)
    found = nearest(src, src, "vec_id", VECTORS, 5, Metric(p), skip_self=True)
    return found.select("vec_id", "rank", "base_key", r6("distance").alias("distance"))


@query("knn_euclid", _near_sql("euclid", 5) + _NEAR_COLUMNS)
def knn_euclid(spark, folder):
    return _near_rows(spark, folder, 2.0)


@query("knn_manhattan", _near_sql("manhattan", 5) + _NEAR_COLUMNS)
def knn_manhattan(spark, folder):
    return _near_rows(spark, folder, 1.0)


@query("knn_chebyshev", _near_sql("chebyshev", 5) + _NEAR_COLUMNS)
def knn_chebyshev(spark, folder):
    return _near_rows(spark, folder, float("inf"))


@query("knn_minkowski", _near_sql("minkowski3", 5) + _NEAR_COLUMNS)
def knn_minkowski(spark, folder):
    return _near_rows(spark, folder, 3.0)


@query("knn_distance_weighted", _near_sql("euclid", 15) + """,
s AS (SELECT vec_id, sum(y / distance) / sum(1 / distance) AS p FROM near GROUP BY 1)
SELECT vec_id, round(p, 6) AS probability, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS prediction FROM s""")
def knn_distance_weighted(spark, folder):
    votes = _voted(spark, folder, 2.0, 15, "distance")
    return votes.select(
        "vec_id", r6("probability").alias("probability"),
        F.when(F.col("probability") > 0.5, 1).otherwise(-1).alias("prediction"),
    )


@query("knn_uniform", _near_sql("manhattan", 3) + """
SELECT vec_id, round(avg(y), 6) AS probability FROM near GROUP BY 1""")
def knn_uniform(spark, folder):
    votes = _voted(spark, folder, 1.0, 3, "uniform")
    return votes.select("vec_id", r6("probability").alias("probability"))


@query("knn_classifier", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},
near AS (SELECT * FROM (
  SELECT q.event_id, t.y, d, row_number() OVER (PARTITION BY q.event_id ORDER BY d, t.event_id) AS r
  FROM folds q JOIN folds t ON q.fold = 'test' AND t.fold = 'train',
       LATERAL (SELECT sqrt((q.value-t.value)*(q.value-t.value) + (q.k-t.k)*(q.k-t.k)) AS d) x)
  WHERE r <= 15),
votes AS (SELECT event_id, CASE WHEN min(d) = 0 THEN avg(y) FILTER (WHERE d = 0)
            ELSE sum(y / d) FILTER (WHERE d > 0) / sum(1 / d) FILTER (WHERE d > 0) END AS p
          FROM near GROUP BY 1)
SELECT event_id, round(p, 6) AS probability, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS prediction
FROM votes""")
def knn_classifier(spark, folder):
    """Fit on the train fold, score the test fold; zero and equal distances occur.

    Unscaled, as inside an ensemble: scaled by rounded means, equal distances
    would be told apart by their last bit.
    """
    folds = _folds(spark, folder)
    train = folds.where("fold = 'train'")
    model = knn.fit(train, "event_id", "y", ["value", "k"], {}, scale=False)
    scored = model.score(folds.where("fold = 'test'"))
    return scored.select("event_id", r6("probability").alias("probability"), "prediction")


@query("knn_scaled")
def knn_scaled(spark, folder):
    """The same with the model's own scaling."""
    return _fitted(spark, folder, "knn", {})


def _folds(spark, folder):
    src = events(spark, folder).select("event_id", "y", "value", "k", "u")
    return stage_table(sample.split_random(src, "y", ["event_id"], 42, 0.3), "folds")


# ---- closed forms ---------------------------------------------------------


@query("lda_moments", """
WITH e AS (SELECT CAST(label = 1 AS INTEGER) AS y, list_concat([1.0::DOUBLE], CAST(embedding AS DOUBLE[])) AS v
           FROM embeddings),
ix AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM range(65) a(i), range(65) b(j) WHERE i <= j)
SELECT y AS label, i, j, round(sum(v[i + 1] * v[j + 1]), 4) + 0.0 AS total FROM e, ix GROUP BY 1, 2, 3""")
def lda_moments(spark, folder):
    """All 2,145 sums of products of 64 features per class, in one pass."""
    sums = moments.product_sums(embeddings(spark, folder), "y", VECTORS)
    return sums.withColumn("total", F.round("total", 4) + F.lit(0.0))


_LDA = f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},
st AS (SELECT y, count(*) AS n, avg(value) AS m1, avg(k) AS m2, var_pop(value) AS s11,
              var_pop(k) AS s22, covar_pop(value, k) AS s12
       FROM folds WHERE fold = 'train' GROUP BY y),
p AS (SELECT a.n AS n0, b.n AS n1, a.m1 AS a1, a.m2 AS a2, b.m1 AS b1, b.m2 AS b2,
        (a.n * a.s11 + b.n * b.s11) / (a.n + b.n) AS s11,
        (a.n * a.s12 + b.n * b.s12) / (a.n + b.n) AS s12,
        (a.n * a.s22 + b.n * b.s22) / (a.n + b.n) AS s22
      FROM st a JOIN st b ON a.y = 0 AND b.y = 1),
w AS (SELECT *, (s22 * (b1 - a1) - s12 * (b2 - a2)) / (s11 * s22 - s12 * s12) AS w1,
        (s11 * (b2 - a2) - s12 * (b1 - a1)) / (s11 * s22 - s12 * s12) AS w2 FROM p),
scored AS (SELECT event_id, y, fold, 1 / (1 + exp(-(w1 * value + w2 * k
        - 0.5 * (w1 * (a1 + b1) + w2 * (a2 + b2)) + ln(n1 / n0)))) AS probability FROM folds, w)"""


def _lda_scored(spark, folder):
    folds = _folds(spark, folder)
    model = fit_model(
        "lda", folds.where("fold = 'train'"), "event_id", "y", ["value", "k"], {"shrinkage": None}
    )
    return model.score(folds)


@query("lda_score", _LDA + """
SELECT event_id, fold, round(probability, 6) AS probability,
       CASE WHEN probability > 0.5 THEN 1 ELSE -1 END AS prediction FROM scored""")
def lda_score(spark, folder):
    """Discriminant on two features: fit on train, score both folds."""
    scored = _lda_scored(spark, folder)
    return scored.select("event_id", "fold", r6("probability").alias("probability"), "prediction")


@query("model_roundtrip", _LDA + """
SELECT event_id, fold, round(probability, 6) AS probability,
       CASE WHEN probability > 0.5 THEN 1 ELSE -1 END AS prediction FROM scored""")
def model_roundtrip(spark, folder):
    """The model fitted on train, saved, loaded, and then scored."""
    folds = _folds(spark, folder)
    model = fit_model(
        "lda", folds.where("fold = 'train'"), "event_id", "y", ["value", "k"], {"shrinkage": None}
    )
    path = staging_path(spark, "model")
    save_model(spark, model, path)
    scored = load_model(spark, path).score(folds)
    return scored.select("event_id", "fold", r6("probability").alias("probability"), "prediction")


@query("lda_svd_offset", _LDA + """
SELECT event_id, fold, CASE WHEN probability > 0.5 THEN 1 ELSE -1 END AS prediction,
       round(probability, 1) AS tenth FROM scored WHERE abs(probability * 10 - round(probability * 10)) < 0.49""")
def lda_svd_offset(spark, folder):
    """The singular value solver; a large offset on one feature changes no prediction."""
    folds = _folds(spark, folder).withColumn("value", F.col("value") + 1e9)
    model = fit_model(
        "lda", folds.where("fold = 'train'"), "event_id", "y", ["value", "k"],
        {"solver": "svd", "shrinkage": None},
    )
    scored = model.score(folds)
    # what lies next to a rounding edge is left out on both sides
    ten = F.col("probability") * 10
    return scored.where(F.abs(ten - F.round(ten)) < 0.49).select(
        "event_id", "fold", "prediction", F.round("probability", 1).alias("tenth")
    )


@query("lda_test_metrics", _LDA + """,
c AS (SELECT fold, probability, count_if(y = 1) AS p, count_if(y = 0) AS n
      FROM scored WHERE fold = 'test' GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER (ORDER BY probability DESC) AS tp,
        sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c),
l AS (SELECT avg(CASE WHEN y = 1 THEN -ln(probability) ELSE -ln(1 - probability) END) AS loss
      FROM scored WHERE fold = 'test')
SELECT round(sum(n * (tp - p / 2.0)) / (max(ap) * max(an)), 4) AS auc, round(max(loss), 6) AS log_loss
FROM r, l""")
def lda_test_metrics(spark, folder):
    """Split, fit, score and evaluate end to end."""
    test = _lda_scored(spark, folder).where("fold = 'test'")
    running = evaluate.running_counts(test, "y", "probability")
    area = evaluate.areas(running).withColumn("__one", F.lit(1))
    loss = evaluate.log_loss(test, "y", "probability").withColumn("__one", F.lit(1))
    return area.join(loss, "__one").select(
        F.round("auc", 4).alias("auc"), r6("log_loss").alias("log_loss")
    )


@query("lda_shrunk", f"""
WITH {EVENTS},
st AS (SELECT avg(value) AS m1, stddev_pop(value) AS d1, avg(k) AS m2, stddev_pop(k) AS d2 FROM ev),
z AS (SELECT event_id, y, (value - m1) / d1 AS x1, (k - m2) / d2 AS x2 FROM ev, st),
c AS (SELECT y, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2,
       0.1 * var_pop(x1) + 0.9 * (var_pop(x1) + var_pop(x2)) / 2 AS s11,
       0.1 * var_pop(x2) + 0.9 * (var_pop(x1) + var_pop(x2)) / 2 AS s22,
       0.1 * covar_pop(x1, x2) AS s12 FROM z GROUP BY y),
p AS (SELECT a.n AS n0, b.n AS n1, a.m1 AS a1, a.m2 AS a2, b.m1 AS b1, b.m2 AS b2,
        (a.n * a.s11 + b.n * b.s11) / (a.n + b.n) AS s11,
        (a.n * a.s12 + b.n * b.s12) / (a.n + b.n) AS s12,
        (a.n * a.s22 + b.n * b.s22) / (a.n + b.n) AS s22
      FROM c a JOIN c b ON a.y = 0 AND b.y = 1),
w AS (SELECT *, (s22 * (b1 - a1) - s12 * (b2 - a2)) / (s11 * s22 - s12 * s12) AS w1,
        (s11 * (b2 - a2) - s12 * (b1 - a1)) / (s11 * s22 - s12 * s12) AS w2 FROM p)
SELECT event_id, round(1 / (1 + exp(-(w1 * x1 + w2 * x2
        - 0.5 * (w1 * (a1 + b1) + w2 * (a2 + b2)) + ln(n1 / n0)))), 6) AS probability FROM z, w""")
def lda_shrunk(spark, folder):
    """Shrinkage 0.9, which depends on the model's own scaling."""
    src = events(spark, folder).select("event_id", "y", "value", "k")
    model = discriminant.fit(src, "event_id", "y", ["value", "k"], {"shrinkage": 0.9})
    return model.score(src).select("event_id", r6("probability").alias("probability"))


@query("nb_score", f"""
WITH {EVENTS},
a AS (SELECT greatest(var_pop(value), var_pop(k)) * 1e-9 AS e FROM ev),
st AS (SELECT y, count(*) AS n, avg(value) AS m1, var_pop(value) + max(e) AS s1, avg(k) AS m2,
              var_pop(k) + max(e) AS s2 FROM ev, a GROUP BY y),
l AS (SELECT ev.event_id, st.y, ln(n) - 0.5 * (ln(s1) + (value - m1) * (value - m1) / s1
        + ln(s2) + (k - m2) * (k - m2) / s2) AS ll FROM ev, st),
w AS (SELECT event_id, max(ll) FILTER (WHERE y = 1) - max(ll) FILTER (WHERE y = 0) AS m
      FROM l GROUP BY 1)
SELECT event_id, round(1 / (1 + exp(-m)), 6) AS probability,
       CASE WHEN m > 0 THEN 1 ELSE -1 END AS prediction FROM w""")
def nb_score(spark, folder):
    src = events(spark, folder).select("event_id", "y", "value", "k")
    model = fit_model("naive_bayes", src, "event_id", "y", ["value", "k"])
    return model.score(src).select(
        "event_id", r6("probability").alias("probability"), "prediction"
    )


@query("nb_offset", f"""
WITH {EVENTS},
a AS (SELECT greatest(var_pop(value), var_pop(k)) * 1e-9 AS e FROM ev),
st AS (SELECT y, count(*) AS n, avg(value) AS m1, var_pop(value) + max(e) AS s1, avg(k) AS m2,
              var_pop(k) + max(e) AS s2 FROM ev, a GROUP BY y),
l AS (SELECT ev.event_id, st.y, ln(n) - 0.5 * (ln(s1) + (value - m1) * (value - m1) / s1
        + ln(s2) + (k - m2) * (k - m2) / s2) AS ll FROM ev, st),
w AS (SELECT event_id, max(ll) FILTER (WHERE y = 1) - max(ll) FILTER (WHERE y = 0) AS m
      FROM l GROUP BY 1)
SELECT event_id, round(1 / (1 + exp(-m)), 4) AS probability,
       CASE WHEN m > 0 THEN 1 ELSE -1 END AS prediction FROM w""")
def nb_offset(spark, folder):
    """A feature with a large offset is told apart like the feature without it."""
    src = events(spark, folder).select("event_id", "y", (F.col("value") + 1e9).alias("value"), "k")
    model = fit_model("naive_bayes", src, "event_id", "y", ["value", "k"])
    return model.score(src).select(
        "event_id", F.round("probability", 4).alias("probability"), "prediction"
    )


# ---- iterative models -----------------------------------------------------


def _fitted(spark, folder, algorithm, settings):
    folds = _folds(spark, folder)
    features = ["value", "k", "u"]
    model = fit_model(
        algorithm, folds.where("fold = 'train'"), "event_id", "y", features, settings
    )
    return model.score(folds).select("event_id", "fold", "y", "probability", "prediction")


@query("logreg_score")
def logreg_score(spark, folder):
    return _fitted(spark, folder, "logistic_regression", {"C": 0.5})


@query("logreg_l1_score")
def logreg_l1_score(spark, folder):
    return _fitted(spark, folder, "logistic_regression", {"penalty": "l1", "C": 0.05})


def _optimal_sql() -> str:
    means = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, CAST(0 AS DOUBLE) AS violation FROM folds WHERE fold = 'train'"
        for f in ("value", "k", "u")
    )
    return f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")}
{means} UNION ALL SELECT 'constant', CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"""


def _optimality(spark, folder, settings):
    """Per feature, how far the fitted weights are from the conditions of the least penalised loss."""
    train, names = _folds(spark, folder).where("fold = 'train'"), ["value", "k", "u"]
    model = fit_model("logistic_regression", train, "event_id", "y", names, settings)
    facts = train.agg(
        *[F.avg(f).alias(f"mean_{f}") for f in names], *[F.stddev_pop(f).alias(f"dev_{f}") for f in names],
        F.count("*").alias("n"), F.sum("y").alias("n1"),
    ).first()
    heavy = F.when(F.col("y") == 1, facts["n"] / (2 * facts["n1"])).otherwise(facts["n"] / (2 * (facts["n"] - facts["n1"])))
    error = heavy * (F.col("probability") - F.col("y"))
    z = {f: (F.col(f) - facts[f"mean_{f}"]) / facts[f"dev_{f}"] for f in names}
    slopes = model.score(train).agg(*[F.sum(error * z[f]).alias(f) for f in names], F.sum(error).alias("constant")).first()
    l1, l2 = newton.penalties({"penalty": "l2", "l1_ratio": None, **settings})
    rows = [("constant", 1.0, abs(slopes["constant"]) / facts["n"])]
    for f, w in zip(names, model.weights):
        w *= facts[f"dev_{f}"]
        slope = slopes[f] + l2 * w
        off = abs(slope + l1 * (1 if w > 0 else -1)) if w else max(abs(slope) - l1, 0.0)
        rows.append((f, facts[f"mean_{f}"], off / facts["n"]))
    found = spark.createDataFrame(rows, "feature string, mean double, violation double")
    return found.select("feature", r6("mean").alias("mean"), r6("violation").alias("violation"))


@query("logreg_optimality", _optimal_sql())
def logreg_optimality(spark, folder):
    return _optimality(spark, folder, {"C": 0.5})


@query("logreg_l1_optimality", _optimal_sql())
def logreg_l1_optimality(spark, folder):
    return _optimality(spark, folder, {"penalty": "l1", "C": 0.005})


@query("lda_auto_shrink")
def lda_auto_shrink(spark, folder):
    return _fitted(spark, folder, "lda", {"shrinkage": "auto"})


@query("lda_svd")
def lda_svd(spark, folder):
    return _fitted(spark, folder, "lda", {"solver": "svd", "shrinkage": None})


# Regularisation and the row and feature shares are all in use; the three differ in the former only.
_BOOSTED = {
    "n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "min_child_weight": 20, "subsample": 0.9,
    "colsample_bytree": 0.7, "max_bin": 64, "random_state": 228,
}
_REGULAR = {"reg_lambda": 1.5, "reg_alpha": 1.5, "gamma": 1.5}
_FREE = {"reg_lambda": 0.0, "reg_alpha": 0.0, "gamma": 0.0}
_STRONG = {"reg_lambda": 50.0, "reg_alpha": 20.0, "gamma": 6.0}


def _boosted_sql(settings):
    made = boosted_sql("folds", "event_id", "y", ["value", "k", "u"], {**_BOOSTED, **settings}, "fold = 'train'")
    return f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},{made}
SELECT event_id, fold, y, round(1 / (1 + exp(-margin)), 6) + 0.0 AS probability,
       CASE WHEN 1 / (1 + exp(-margin)) > 0.5 THEN 1 ELSE -1 END AS prediction FROM scored"""


def _boosted(spark, folder, settings):
    return _fitted(spark, folder, "xgboost", {**_BOOSTED, **settings}).withColumn("probability", r6("probability"))


@query("gbt_score", _boosted_sql(_REGULAR))
def gbt_score(spark, folder):
    return _boosted(spark, folder, _REGULAR)


@query("gbt_no_reg", _boosted_sql(_FREE))
def gbt_no_reg(spark, folder):
    return _boosted(spark, folder, _FREE)


@query("gbt_strong_reg", _boosted_sql(_STRONG))
def gbt_strong_reg(spark, folder):
    return _boosted(spark, folder, _STRONG)


@query("tree_score", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},{tree_sql("folds", "y", ["value", "k", "u"], 5, "fold = 'train'")}
SELECT event_id, fold, y, round(probability, 6) + 0.0 AS probability, CASE WHEN probability > 0.5 THEN 1 ELSE -1 END AS prediction FROM scored""")
def tree_score(spark, folder):
    """An exact tree of five levels."""
    return _fitted(spark, folder, "decision_tree", {"max_depth": 5}).withColumn("probability", r6("probability"))


@query("flagship")
def flagship(spark, folder):
    """Raw events to metrics per fold: encode, engineer, split, scale, oversample, fit, score."""
    src = events(spark, folder).select(
        F.col("event_id").alias("id"), "user_name", "value", "k", F.col("at").alias("Time"),
        F.when(F.col("y") == 1, "yes").otherwise("no").alias("Class"),
    )
    cfg = DataConfig(additional_feature_names=("Time",), feature_scaling="minmax")
    made = prepare.prepare(src, cfg)
    model = fit_model("lda", made.train, prepare.KEY, made.label, made.features)
    scored = model.score(made.data).select("fold", "Class", "probability", "prediction")
    rates = evaluate.fold_metrics(scored, "Class", "prediction")
    running = evaluate.running_counts(scored, "Class", "probability", ["fold"])
    loss = evaluate.log_loss(scored, "Class", "probability", ["fold"])
    return rates.join(evaluate.areas(running, ["fold"]), "fold").join(loss, "fold")
