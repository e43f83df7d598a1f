"""Many runs at once: evaluation per run, saved runs, comparison tables.

One run per supplier: its line items scored and labelled, named after the
supplier's nation, so model names repeat as they do among real runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rarelane.catalog.registry import EVENTS, events, query, r6, split_sql, table
from rarelane.config import DataConfig, Experiment
from rarelane.operators import compare, evaluate
from rarelane.plans.experiment import run_grid
from rarelane.session import stage_table, staging_path
from rarelane.sources import runs as store


def _lines(spark, folder):
    coarse = F.round(F.col("l_discount") * 100) + F.col("l_quantity") % 7
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("supplier/"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias(
            "experiment"
        ),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("fold"),
        (coarse / 20).alias("p"),
        F.when(coarse / 20 > 0.4, 1).otherwise(-1).alias("prediction"),
        "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
    )


_LINES = """ln AS (
  SELECT 'supplier/' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS experiment,
         CAST(l_returnflag = 'R' AS INTEGER) AS y,
         CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS fold,
         (round(l_discount * 100) + l_quantity % 7) / 20 AS p,
         CASE WHEN (round(l_discount * 100) + l_quantity % 7) / 20 > 0.4 THEN 1 ELSE -1 END AS prediction,
         l_suppkey, l_quantity, l_discount, l_tax, l_returnflag
  FROM lineitem)"""

_RUNS = f"""{_LINES},
c AS (SELECT experiment, p AS score, count_if(y = 1) AS pos, count_if(y = 0) AS neg
      FROM ln WHERE fold = 'test' GROUP BY 1, 2),
run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
          sum(pos) OVER (PARTITION BY experiment) AS ap, sum(neg) OVER (PARTITION BY experiment) AS an,
          lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS rn,
          lag(pos) OVER w AS lpos
        FROM c WINDOW w AS (PARTITION BY experiment ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / (tp + fp) AS precision,
         coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY experiment ORDER BY score DESC), 1) AS before
       FROM run),
area AS (SELECT experiment, round(sum(neg * (tp - pos / 2)) / (max(ap) * max(an)), 6) AS auc,
           round(sum(pos / ap * (precision + before) / 2), 6) AS auc_pr FROM pr GROUP BY 1),
cm AS (SELECT experiment, count_if(y = 0 AND prediction = -1) AS tn,
         count_if(y = 0 AND prediction = 1) AS fp, count_if(y = 1 AND prediction = -1) AS fn,
         count_if(y = 1 AND prediction = 1) AS tp FROM ln WHERE fold = 'test' GROUP BY 1),
rates AS (SELECT experiment,
            round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS test_precision,
            round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS test_recall,
            round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS test_f1,
            round((tp + tn) / (tp + tn + fp + fn), 6) AS test_accuracy FROM cm),
losses AS (SELECT experiment, round(avg(CASE WHEN y = 1
             THEN -ln(greatest(p, 2.220446049250313e-16))
             ELSE -ln(1 - greatest(p, 2.220446049250313e-16)) END), 6) AS log_loss
           FROM ln WHERE fold = 'test' GROUP BY 1),
times AS (SELECT experiment, l_suppkey, round(sum(l_tax), 2) AS data_prep,
            round(sum(l_discount) / 10, 3) AS fit, round(avg(l_quantity) / 10, 3) AS predict,
            round(sum(l_tax) FILTER (WHERE l_returnflag = 'A'), 2) AS solve,
            round(sum(l_tax) FILTER (WHERE l_returnflag = 'N') / 100, 4) AS get_hamiltonian
          FROM ln GROUP BY 1, 2),
runs AS (SELECT t.experiment, 'nation ' || CAST(s_nationkey AS VARCHAR) AS model_name,
           auc, auc_pr, log_loss, test_precision, test_recall, test_f1, test_accuracy,
           data_prep, CASE WHEN s_nationkey < 10 THEN NULL ELSE fit END AS fit, predict,
           CASE WHEN s_nationkey < 10 THEN solve END AS solve,
           CASE WHEN s_nationkey < 10 THEN get_hamiltonian END AS get_hamiltonian
         FROM times t JOIN supplier ON s_suppkey = l_suppkey
         JOIN area USING (experiment) JOIN rates USING (experiment) JOIN losses USING (experiment))"""


def saved_runs(spark, folder):
    """One row per supplier in the format of a saved run."""
    lines = _lines(spark, folder)
    test = lines.where("fold = 'test'")
    by = ["experiment"]
    running = evaluate.running_counts(test, "y", "p", by)
    area = evaluate.areas(running, by).select(
        "experiment", r6("auc").alias("auc"), r6("auc_pr").alias("auc_pr")
    )
    curves = evaluate.curve_arrays(running, by)
    rates = evaluate.fold_metrics(lines, "y", "prediction", "fold", by)
    for c in ("precision", "recall", "f1", "accuracy"):
        rates = rates.withColumn(c, r6(c))
    metrics = rates.select("experiment", "fold", evaluate.metrics_struct(F.col("fold")).alias("m"))
    folds = metrics.groupBy("experiment").agg(
        F.first(F.when(F.col("fold") == "train", F.col("m")), True).alias("train_metrics"),
        F.first(F.when(F.col("fold") == "test", F.col("m")), True).alias("test_metrics"),
    )
    loss = evaluate.log_loss(test, "y", "p", by).withColumn("log_loss", r6("log_loss"))
    part = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_tax")))
    times = lines.groupBy("experiment", "l_suppkey").agg(
        F.round(F.sum("l_tax"), 2).alias("data_prep"),
        F.round(F.sum("l_discount") / 10, 3).alias("fit"),
        F.round(F.avg("l_quantity") / 10, 3).alias("predict"),
        F.round(part("A"), 2).alias("solve"),
        F.round(part("N") / 100, 4).alias("get_hamiltonian"),
    )
    remote = F.col("s_nationkey") < 10
    adapter = F.when(
        remote,
        F.create_map(F.lit("solve"), "solve", F.lit("get_hamiltonian"), "get_hamiltonian"),
    ).otherwise(F.create_map().cast("map<string,double>"))
    timing = F.struct(
        "data_prep", F.when(~remote, F.col("fit")).alias("fit"), "predict",
        adapter.alias("adapter"),
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    named = times.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "experiment",
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("model_name"),
        timing.alias("timing"),
    )
    whole = named.join(area, by).join(curves, by).join(folds, by).join(loss, by)
    return store.complete_runs(
        whole.withColumn("training_time_seconds", store.total_seconds())
    )


def stored_runs(spark, folder):
    """The runs, evaluated once and staged, as a comparison would find them."""
    return stage_table(saved_runs(spark, folder), "runs")


_AREAS = f"WITH {_RUNS} SELECT experiment, auc, auc_pr, log_loss FROM runs"


@query("runs_evaluated", _AREAS)
def runs_evaluated(spark, folder):
    """Areas and log loss of all runs from the same few aggregates."""
    return saved_runs(spark, folder).select("experiment", "auc", "auc_pr", "log_loss")


_TOTAL = "round(data_prep + coalesce(fit, solve + get_hamiltonian, 0) + predict, 6)"
_FLAT = f"""experiment, model_name, auc AS auc_roc, auc_pr, log_loss, test_precision, test_recall,
  test_f1, test_accuracy, data_prep AS timing_data_prep, fit AS timing_fit,
  predict AS timing_predict, {_TOTAL} AS timing_total_seconds"""


@query("flatten_results", f"WITH {_RUNS} SELECT {_FLAT} FROM runs")
def flatten_results(spark, folder):
    flat = compare.flatten_runs(stored_runs(spark, folder))
    return flat.withColumn("timing_total_seconds", r6("timing_total_seconds"))


@query("results_roundtrip", f"WITH {_RUNS} SELECT {_FLAT} FROM runs")
def results_roundtrip(spark, folder):
    """Runs written as JSON documents and read back."""
    path = staging_path(spark, "runs")
    store.write_runs(stored_runs(spark, folder), path)
    flat = compare.flatten_runs(store.read_run_store(spark, path))
    return flat.withColumn("timing_total_seconds", r6("timing_total_seconds"))


@query("runs_scan", f"""
WITH {_RUNS}, d AS (SELECT *, CAST(right(experiment, 1) AS INTEGER) % 2 = 1 AS old,
  data_prep + coalesce(fit, solve + get_hamiltonian, 0) + predict AS total FROM runs)
SELECT right(experiment, 9) AS supplier, model_name, auc AS auc_roc, CASE WHEN old THEN 0 ELSE auc_pr END AS auc_pr,
  test_f1, CASE WHEN old THEN 0 ELSE data_prep END AS timing_data_prep, CASE WHEN old THEN round(total, 6) ELSE fit END AS timing_fit,
  CASE WHEN old THEN 0 ELSE predict END AS timing_predict, round(total, 6) AS timing_total_seconds FROM d""")
def runs_scan(spark, folder):
    """Documents in folders of different depth; every second one is old, without times and curve of its own."""
    path, runs = staging_path(spark, "documents"), stored_runs(spark, folder)
    old = F.substring("experiment", -1, 1).cast("int") % 2 == 1
    store.write_runs(runs.where(~old), f"{path}/new")
    earlier = runs.where(old).withColumn("training_time_seconds", store.total_seconds())
    earlier = store.spread_runs(earlier.drop("timing", "pr_precision", "pr_recall", "auc_pr"))
    earlier.write.partitionBy("experiment").json(f"{path}/archive/deep/old")
    flat = compare.flatten_runs(store.read_runs(spark, path))
    return flat.select(
        F.regexp_extract("experiment", "supplier%(?:25)*2F([0-9]+)", 1).alias("supplier"), "model_name", "auc_roc", "auc_pr", "test_f1",
        "timing_data_prep", r6("timing_fit").alias("timing_fit"), "timing_predict", r6("timing_total_seconds").alias("timing_total_seconds"),
    )


@query("curve_store", f"""
WITH {_RUNS}
SELECT experiment, 'roc' AS curve, count(*) AS points, round(sum(x), 4) AS xs, round(sum(y), 4) AS ys FROM (
  SELECT experiment, fp / an AS x, tp / ap AS y FROM run
    WHERE rn = 1 OR npos IS NULL OR pos <> npos OR neg <> nneg
  UNION ALL SELECT experiment, 0, 0 FROM run WHERE rn = 1) GROUP BY 1
UNION ALL
SELECT experiment, 'pr', count(*), round(sum(x), 4), round(sum(y), 4) FROM (
  SELECT experiment, tp / ap AS x, tp / (tp + fp) AS y FROM run
  UNION ALL SELECT experiment, 0, 1 FROM run WHERE rn = 1) GROUP BY 1""")
def curve_store(spark, folder):
    """Curve points of all runs saved as tables, saved again, and read back."""
    path = staging_path(spark, "store")
    by = ["experiment"]
    running = evaluate.running_counts(_lines(spark, folder).where("fold = 'test'"), "y", "p", by)
    running = stage_table(running, "running")
    for _ in range(2):
        store.write_curves(evaluate.roc_points(running, by), evaluate.pr_points(running, by), path)
    sums = [
        store.read_curves(spark, path, name).groupBy("experiment").agg(
            F.count("*").alias("points"), F.round(F.sum(x), 4).alias("xs"), F.round(F.sum(y), 4).alias("ys")
        ).select("experiment", F.lit(name).alias("curve"), "points", "xs", "ys")
        for name, x, y in (("roc", "fpr", "tpr"), ("pr", "recall", "precision"))
    ]
    return sums[0].unionByName(sums[1])


@query("comparison_csv", f"""
WITH {_RUNS} SELECT {_FLAT.replace("experiment, ", "", 1)}, solve AS timing_solve,
  get_hamiltonian AS timing_get_hamiltonian FROM runs""")
def comparison_csv(spark, folder):
    """The comparison table written as CSV and read back; blanks are NULL."""
    path = staging_path(spark, "comparison")
    store.write_comparison_csv(stored_runs(spark, folder), path)
    schema = "model_name string, " + ", ".join(
        f"{c} double" for c in
        [*compare.BASE_COLUMNS[1:], "timing_solve", "timing_get_hamiltonian"]
    )
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.withColumn("timing_total_seconds", r6("timing_total_seconds"))


@query("adapter_pivot", f"""
WITH {_RUNS} SELECT experiment, solve AS timing_solve, get_hamiltonian AS timing_get_hamiltonian
FROM runs WHERE solve IS NOT NULL OR get_hamiltonian IS NOT NULL""")
def adapter_pivot(spark, folder):
    return compare.pivot_adapter_times(stored_runs(spark, folder))


@query("metric_ranking", f"""
WITH {_RUNS}, l AS (SELECT experiment, model_name, 'auc' AS metric, auc AS value FROM runs
  UNION ALL SELECT experiment, model_name, 'log_loss', log_loss FROM runs)
SELECT *, CAST(row_number() OVER (PARTITION BY metric
  ORDER BY value DESC, model_name DESC, experiment DESC) AS INTEGER) AS rank FROM l""")
def metric_ranking(spark, folder):
    return compare.metric_ranking(stored_runs(spark, folder))


@query("roc_points", f"""
WITH {_RUNS}, ranks AS (SELECT experiment, model_name, auc, CAST(row_number() OVER (
  ORDER BY auc DESC, experiment) AS INTEGER) AS rank FROM runs),
kept AS (SELECT experiment, fp / an AS fpr, tp / ap AS tpr, score FROM run
  WHERE rn = 1 OR npos IS NULL OR pos <> npos OR neg <> nneg
  UNION ALL SELECT experiment, 0, 0, 99 FROM run WHERE rn = 1)
SELECT rank, experiment, model_name, auc, CAST(row_number() OVER (PARTITION BY experiment
  ORDER BY score DESC) - 1 AS INTEGER) AS point, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr
FROM kept JOIN ranks USING (experiment)""")
def roc_points(spark, folder):
    """Tidy ROC points of all runs, ranked by area."""
    points = compare.roc_table(stored_runs(spark, folder))
    return points.withColumns({"fpr": r6("fpr"), "tpr": r6("tpr")})


@query("pr_points", f"""
WITH {_RUNS}, ranks AS (SELECT experiment, model_name, auc_pr, CAST(row_number() OVER (
  ORDER BY auc_pr DESC, experiment) AS INTEGER) AS rank FROM runs),
kept AS (SELECT experiment, tp / (tp + fp) AS precision, tp / ap AS recall, score FROM run
  UNION ALL SELECT experiment, 1, 0, 99 FROM run WHERE rn = 1)
SELECT rank, experiment, model_name, auc_pr, CAST(row_number() OVER (PARTITION BY experiment
  ORDER BY score) - 1 AS INTEGER) AS point, round(recall, 6) AS recall,
  round(precision, 6) AS precision
FROM kept JOIN ranks USING (experiment)""")
def pr_points(spark, folder):
    points = compare.pr_table(stored_runs(spark, folder))
    return points.withColumns({"recall": r6("recall"), "precision": r6("precision")})


@query("timing_stack", f"""
WITH {_RUNS}, st AS (
  SELECT experiment, 0 AS place, 'Data Prep' AS stage, data_prep AS seconds FROM runs
  UNION ALL SELECT experiment, 1, 'Fit', coalesce(fit, 0) FROM runs
  UNION ALL SELECT experiment, 2, 'Predict', predict FROM runs
  UNION ALL SELECT experiment, 3, 'Solve', solve FROM runs WHERE solve IS NOT NULL
  UNION ALL SELECT experiment, 4, 'Get_Hamiltonian', get_hamiltonian FROM runs
            WHERE get_hamiltonian IS NOT NULL),
top AS (SELECT max(t) AS tallest FROM (SELECT sum(seconds) AS t FROM st GROUP BY experiment)),
bt AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY experiment ORDER BY place
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bottom FROM st)
SELECT experiment, CAST(place AS INTEGER) AS place, stage, seconds, round(bottom, 6) AS bottom,
       seconds < 0.03 * tallest AS small FROM bt, top WHERE seconds > 0""")
def timing_stack(spark, folder):
    stacked = compare.timing_stack(stored_runs(spark, folder))
    return stacked.withColumn("bottom", r6("bottom"))


@query("skip_finished", """
WITH e AS (SELECT DISTINCT 'tests/supplier/' || CAST(s_suppkey AS VARCHAR) || '.yaml' AS path, s_suppkey FROM supplier)
SELECT path, 'results/supplier/' || CAST(s_suppkey AS VARCHAR) || '.json' AS experiment FROM e
WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 AND l_returnflag = 'R')""")
def skip_finished(spark, folder):
    """Experiments whose result path has no saved run."""
    planned = table(spark, folder, "supplier").select(
        F.concat(F.lit("tests/supplier/"), F.col("s_suppkey").cast("string"), F.lit(".yaml"))
        .alias("path")
    )
    planned = planned.withColumn("experiment", compare.result_path(F.col("path")))
    done = table(spark, folder, "lineitem").where("l_quantity = 50 AND l_discount = 0.1 AND l_returnflag = 'R'")
    finished = done.select(
        F.concat(F.lit("results/supplier/"), F.col("l_suppkey").cast("string"), F.lit(".json"))
        .alias("experiment")
    )
    return compare.skip_finished(planned, finished).select("path", "experiment")


_GRID = {"lda/shrunk": ("lda", {"shrinkage": 0.9}), "nb/plain": ("naive_bayes", {}), "lg/l1": ("logistic_regression", {"penalty": "l1"})}


@query("grid_run", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")}
SELECT experiment, model_name, count_if(fold = 'test') AS test_rows, count_if(fold = 'test' AND y = 1) AS test_positives,
       CAST(2 * count_if(fold = 'train' AND y = 0) AS BIGINT) AS train_rows, TRUE AS curves
FROM folds, (VALUES ('lda/shrunk', 'Linear Discriminant Analysis (Oversampled)'), ('nb/plain', 'Gaussian Naive Bayes (Oversampled)'),
  ('lg/l1', 'Logistic Regression (Oversampled)')) t(experiment, model_name) GROUP BY 1, 2""")
def grid_run(spark, folder):
    """Three experiments on one default preparation, oversampled; a second run finds them finished."""
    src = stage_table(events(spark, folder).select(
        F.col("event_id").alias("id"), "user_name", "value", "k", F.when(F.col("y") == 1, "yes").otherwise("no").alias("Class")
    ), "events")
    data = DataConfig(feature_scaling="standard")
    grid = [Experiment(name, algorithm, settings, data) for name, (algorithm, settings) in _GRID.items()]
    path = staging_path(spark, "grid")
    first = run_grid(spark, grid, path, src)
    saved = {r["experiment"]: r["training_time_seconds"] for r in first.collect()}
    again = run_grid(spark, grid, path, src)
    points = store.read_curves(spark, path, "roc").groupBy("experiment").agg(F.count("*").alias("points"))
    matrix, train = F.col("test_metrics.confusion_matrix"), F.col("train_metrics.confusion_matrix")
    kept = F.element_at(F.create_map(*[F.lit(v) for pair in saved.items() for v in pair]), F.col("experiment"))
    return again.where(F.col("training_time_seconds") == kept).join(points, "experiment").select(
        "experiment", "model_name", (matrix[0][0] + matrix[0][1] + matrix[1][0] + matrix[1][1]).alias("test_rows"),
        (matrix[1][0] + matrix[1][1]).alias("test_positives"),
        (train[0][0] + train[0][1] + train[1][0] + train[1][1]).alias("train_rows"), (F.col("points") > 2).alias("curves"),
    )
