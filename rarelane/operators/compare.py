"""Comparing saved runs: flat tables, rankings, curve points, stage times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rarelane.operators.evaluate import add_score_ranges

# Order and names of the comparison columns.
BASE_COLUMNS = [
    "model_name", "auc_roc", "auc_pr", "log_loss",
    "test_precision", "test_recall", "test_f1", "test_accuracy",
    "timing_data_prep", "timing_fit", "timing_predict", "timing_total_seconds",
]
# Fixed stages of the timing chart, in order.
STAGES = ["Data Prep", "Fit", "Predict"]
# Fixed value: shorter segments are labelled outside their bar.
SMALL_SHARE = 0.03


def _total() -> Column:
    adapter = F.aggregate(F.map_values("timing.adapter"), F.lit(0.0), lambda a, b: a + b)
    return F.col("timing.data_prep") + F.coalesce("timing.fit", adapter) + F.col("timing.predict")


def flatten_runs(runs: DataFrame, keep: tuple[str, ...] = ("experiment",)) -> DataFrame:
    """One flat row per run with the twelve base columns."""
    return runs.select(
        *keep,
        "model_name",
        F.col("auc").alias("auc_roc"),
        "auc_pr",
        "log_loss",
        F.col("test_metrics.precision").alias("test_precision"),
        F.col("test_metrics.recall").alias("test_recall"),
        F.col("test_metrics.f1").alias("test_f1"),
        F.col("test_metrics.accuracy").alias("test_accuracy"),
        F.col("timing.data_prep").alias("timing_data_prep"),
        F.col("timing.fit").alias("timing_fit"),
        F.col("timing.predict").alias("timing_predict"),
        _total().alias("timing_total_seconds"),
    )


def adapter_times(runs: DataFrame) -> DataFrame:
    """Long table ``experiment, place, label, seconds`` of the adapter times."""
    return runs.select(
        "experiment", F.posexplode(F.map_entries("timing.adapter")).alias("place", "entry")
    ).select("experiment", "place", "entry.key", "entry.value").toDF(
        "experiment", "place", "label", "seconds"
    )


def adapter_labels(runs: DataFrame) -> DataFrame:
    """Distinct labels with the first (experiment, place) each is seen at."""
    first = F.min(F.struct("experiment", "place")).alias("first")
    return adapter_times(runs).groupBy("label").agg(first)


def comparison_table(runs: DataFrame) -> DataFrame:
    """Flat rows plus one ``timing_<label>`` column per adapter label.

    Labels are columns of the result, so their list is read to the driver; it
    holds the names of a few solver stages.
    """
    labels = [r["label"] for r in adapter_labels(runs).orderBy("first").collect()]
    flat = flatten_runs(runs)
    times = F.col("timing.adapter")
    if not labels:
        return flat.drop("experiment")
    wide = runs.select(
        F.col("experiment").alias("__e"),
        *[F.try_element_at(times, F.lit(n)).alias(f"timing_{n}") for n in labels],
    )
    joined = flat.join(wide, F.col("experiment") == F.col("__e"))
    return joined.orderBy("experiment").select(*BASE_COLUMNS, *[f"timing_{n}" for n in labels])


def pivot_adapter_times(runs: DataFrame) -> DataFrame:
    """One row per run that has adapter times, one column per label."""
    wide = adapter_times(runs).groupBy("experiment").pivot("label").agg(F.first("seconds"))
    return wide.select(
        "experiment", *[F.col(f"`{c}`").alias(f"timing_{c}") for c in wide.columns[1:]]
    )


def skip_finished(experiments: DataFrame, finished: DataFrame, rerun: bool = False) -> DataFrame:
    """Experiments that have no saved run yet (all of them with ``rerun``)."""
    if rerun:
        return experiments
    return experiments.join(finished.select("experiment"), "experiment", "left_anti")


def result_path(path: Column) -> Column:
    """Path of a saved run: folders named ``tests`` become ``results``, ending ``.json``."""
    folders = F.transform(F.split(path, "/"), lambda p: F.when(p == "tests", "results").otherwise(p))
    return F.regexp_replace(F.array_join(folders, "/"), r"\.[^./]*$", ".json")


RANGE_RUNS = 100_000


def ranked(runs: DataFrame, metric: str) -> DataFrame:
    """Runs by ``metric``, best value first; equal values keep the reading order.

    Only (experiment, metric) is ranked, the curves stay where they are.  Many
    runs are cut into value ranges, each ranked by itself on top of the number
    of runs in the ranges above it.
    """
    narrow = runs.select(F.col("experiment").alias("__e"), F.col(metric).alias("score"))
    ranks = _placed(narrow, [F.desc("score"), F.col("__e")]).select("__e", "rank")
    return runs.join(ranks, F.col("experiment") == F.col("__e")).drop("__e")


def _placed(narrow: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their ``rank`` by ``order``, which begins with the falling ``score``."""
    narrow = add_score_ranges(narrow, RANGE_RUNS)
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = narrow.groupBy(F.col("__range").alias("r")).count()
    before = sizes.select("r", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    placed = narrow.withColumn("__n", F.row_number().over(inside))
    joined = placed.join(F.broadcast(before), placed["__range"].eqNullSafe(before["r"]))
    rank = (F.col("before") + F.col("__n")).cast("int").alias("rank")
    return joined.select(*[c for c in narrow.columns if c != "__range"], rank)


def roc_table(runs: DataFrame) -> DataFrame:
    """ROC points of all runs, runs ranked by area."""
    points = F.posexplode(F.arrays_zip("fpr", "tpr")).alias("point", "at")
    return ranked(runs, "auc").select("rank", "experiment", "model_name", "auc", points).select(
        "rank", "experiment", "model_name", "auc", "point",
        F.col("at.fpr").alias("fpr"), F.col("at.tpr").alias("tpr"),
    )


def pr_table(runs: DataFrame) -> DataFrame:
    """PR points of all runs, ranked by area; runs without a PR curve have none."""
    points = F.posexplode(F.arrays_zip("pr_recall", "pr_precision")).alias("point", "at")
    return ranked(runs, "auc_pr").select(
        "rank", "experiment", "model_name", "auc_pr", points
    ).select(
        "rank", "experiment", "model_name", "auc_pr", "point",
        F.col("at.pr_recall").alias("recall"), F.col("at.pr_precision").alias("precision"),
    )


def metric_ranking(runs: DataFrame, metrics: tuple[str, ...] = ("auc", "log_loss")) -> DataFrame:
    """Rank per metric, highest value first (log loss too), names descending on ties.

    One narrow row per run and metric is ranked, in value ranges like ``ranked``.
    """
    order = [F.desc("score"), F.desc("model_name"), F.desc("experiment")]
    parts = [
        _placed(runs.select("experiment", "model_name", F.col(m).alias("score")), order).select(
            "experiment", "model_name", F.lit(m).alias("metric"), F.col("score").alias("value"), "rank"
        )
        for m in metrics
    ]
    return reduce(DataFrame.unionByName, parts)


def title_case(text: Column) -> Column:
    """Upper case for each letter that does not follow a letter."""
    letters = F.split(F.lower(text), "")

    def one(c: Column, i: Column) -> Column:
        inner = (i > 0) & F.get(letters, i - 1).rlike("[a-z]")
        return F.when(inner, c).otherwise(F.upper(c))

    return F.array_join(F.transform(letters, one), "")


def timing_stack(runs: DataFrame) -> DataFrame:
    """Stacked stage times: ``experiment, place, stage, seconds, bottom, small``.

    Stages without time are left out.  ``small`` marks segments under 3 % of the
    longest run.
    """
    seconds = F.array(
        F.col("timing.data_prep"), F.coalesce("timing.fit", F.lit(0.0)), F.col("timing.predict")
    )
    fixed = runs.select(
        "experiment", F.posexplode(F.arrays_zip(seconds.alias("s"))).alias("place", "at")
    ).select(
        "experiment", "place",
        F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("place") + 1).alias("stage"),
        F.col("at.s").alias("seconds"),
    )
    # One row per label: a small table.
    number = Window.orderBy("first")
    labels = adapter_labels(runs).select(
        "label", (F.row_number().over(number) + len(STAGES) - 1).alias("stage_place")
    )
    extra = adapter_times(runs).join(labels, "label").select(
        "experiment", F.col("stage_place").alias("place"),
        title_case(F.col("label")).alias("stage"), "seconds",
    )
    stages = fixed.unionByName(extra)
    below = (
        Window.partitionBy("experiment").orderBy("place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    tallest = stages.groupBy("experiment").agg(F.sum("seconds").alias("t")).agg(
        F.max("t").alias("tallest")
    )
    stacked = stages.withColumn("bottom", F.coalesce(F.sum("seconds").over(below), F.lit(0.0)))
    return stacked.where(F.col("seconds") > 0).select(
        "experiment", "place", "stage", "seconds", "bottom",
        (F.col("seconds") < SMALL_SHARE * tallest.scalar()).alias("small"),
    )
