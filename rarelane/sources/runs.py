"""Saved runs: JSON documents in and out, the comparison CSV, fitted models."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rarelane.operators.compare import comparison_table

_METRICS = (
    "struct<split:string, precision:double, recall:double, f1:double, accuracy:double, "
    "confusion_matrix:array<array<bigint>>>"
)
_TIMING = "struct<data_prep:double, fit:double, predict:double, adapter:map<string,double>>"

# Field names and types of one saved run.
RUN_SCHEMA = (
    f"model_name string, training_time_seconds double, timing {_TIMING}, "
    "fpr array<double>, tpr array<double>, auc double, "
    "pr_precision array<double>, pr_recall array<double>, auc_pr double, log_loss double, "
    f"train_metrics {_METRICS}, test_metrics {_METRICS}"
)


def complete_runs(raw: DataFrame) -> DataFrame:
    """Fill what older documents lack.

    Without ``timing`` the training time is the fit time; without a PR curve its
    arrays are empty and its area is 0; without adapter times the map is empty.
    """
    empty = F.array().cast("array<double>")
    zero = F.lit(0.0)
    no_times = F.create_map().cast("map<string,double>")
    old = F.struct(
        zero.alias("data_prep"),
        F.coalesce("training_time_seconds", zero).alias("fit"),
        zero.alias("predict"),
        no_times.alias("adapter"),
    )
    new = F.struct(
        F.coalesce("timing.data_prep", zero).alias("data_prep"),
        F.col("timing.fit").alias("fit"),
        F.coalesce("timing.predict", zero).alias("predict"),
        F.coalesce("timing.adapter", no_times).alias("adapter"),
    )
    return raw.withColumns({
        "timing": F.when(F.col("timing").isNull(), old).otherwise(new),
        "pr_precision": F.coalesce("pr_precision", empty),
        "pr_recall": F.coalesce("pr_recall", empty),
        "auc_pr": F.coalesce("auc_pr", zero),
    })


def total_seconds(timing: str = "timing"):
    """Prep + predict + fit, or the adapter times when fit is NULL."""
    t = F.col(timing)
    adapter = F.aggregate(F.map_values(t["adapter"]), F.lit(0.0), lambda a, b: a + b)
    return t["data_prep"] + F.coalesce(t["fit"], adapter) + t["predict"]


def read_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Documents below the given folders (``*.json``) or single files.

    ``experiment`` is the file's path; order by it for the reading order.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = (
        spark.read.schema(RUN_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("multiLine", True)
        .json(paths)
        .withColumn("experiment", F.col("_metadata.file_path"))
    )
    return complete_runs(raw)


def spread_runs(runs: DataFrame) -> DataFrame:
    """Runs dealt to several tasks a core: writing costs by the folder, and few bytes hold many runs."""
    tasks = TASKS_PER_CORE * runs.sparkSession.sparkContext.defaultParallelism
    return runs.repartition(tasks, "experiment")


def write_runs(runs: DataFrame, path: str) -> None:
    """Write runs as JSON, one folder per experiment; a rerun takes the place of its run."""
    named = runs.withColumn("training_time_seconds", total_seconds())
    writer = spread_runs(named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("experiment").json(path)


#: Tasks per core that write runs.
TASKS_PER_CORE = 4

#: Curve points lie beside the runs, in a folder that is not read as runs.
CURVES = "_curves"


def write_curves(roc: DataFrame, pr: DataFrame, path: str) -> None:
    """Write curve points (``experiment`` and the columns of ``roc_points``, ``pr_points``).

    One row a point; the points of all experiments of a call lie together in one batch,
    so files grow with the points, not with the experiments.  A rerun takes the place of
    its curves: the latest batch that holds an experiment is the one read.
    """
    batch = f"{time.time_ns():020d}"
    for name, points in (("roc", roc), ("pr", pr)):
        points.write.parquet(f"{path}/{CURVES}/{name}/batch={batch}")


def read_curves(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Points of all saved runs, ``roc`` or ``pr``."""
    columns = {"roc": "fpr double, tpr double", "pr": "precision double, recall double"}[name]
    schema = f"{columns}, threshold double, experiment string"
    every = spark.read.schema(f"{schema}, batch string").parquet(f"{path}/{CURVES}/{name}")
    latest = every.groupBy(F.col("experiment").alias("__experiment")).agg(F.max("batch").alias("__batch"))
    same = F.col("experiment").eqNullSafe(F.col("__experiment")) & (F.col("batch") == F.col("__batch"))
    return every.join(latest, same, "left_semi").drop("batch")


def read_run_store(spark: SparkSession, path: str) -> DataFrame:
    """Runs written by ``write_runs``, with their experiment names."""
    raw = spark.read.schema(RUN_SCHEMA + ", experiment string").json(path)
    return complete_runs(raw)


def write_comparison_csv(runs: DataFrame, path: str) -> None:
    """The comparison table as CSV; a missing adapter time is blank."""
    comparison_table(runs).write.mode("overwrite").option("header", True).option(
        "emptyValue", ""
    ).csv(path)
