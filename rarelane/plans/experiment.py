"""Running one experiment or a grid of them."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rarelane.config import DataConfig, Experiment
from rarelane.estimators import display_name, fit_model
from rarelane.operators import evaluate
from rarelane.operators.compare import skip_finished
from rarelane.plans.prepare import FOLD, KEY, Prepared, prepare, prepare_files
from rarelane.session import stage_table
from rarelane.sources.models import save_model
from rarelane.sources.runs import RUN_SCHEMA, read_run_store, write_curves, write_runs

#: Experiments of a grid that are evaluated and saved together.
TOGETHER = 32


def run_name(cfg: DataConfig, algorithm: str, settings: Mapping[str, Any]) -> str:
    if cfg.model_name_override is not None:
        return cfg.model_name_override
    name = display_name(algorithm, settings)
    return f"{name} (Oversampled)" if cfg.should_over_sample else name


def curve_tables(scored: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """ROC and PR points of the test fold as tables, for any number of scores."""
    running = evaluate.running_counts(scored.where(F.col(FOLD) == "test"), label, "probability")
    return evaluate.roc_points(running), evaluate.pr_points(running)


def evaluate_scores(scored: DataFrame, label: str, with_curves: bool = True) -> dict[str, Any]:
    """Metrics of both folds, areas and log loss of the test fold, of one run on the driver.

    ``with_curves`` adds its curves as arrays, the form of a single document; runs of
    many distinct scores are saved with curve tables instead (``curve_tables``).
    """
    test = scored.where(F.col(FOLD) == "test").select(label, "probability")
    evaluate.require_two_classes(test, label)
    folds = {
        r[FOLD]: {
            "split": r[FOLD], "precision": r["precision"], "recall": r["recall"],
            "f1": r["f1"], "accuracy": r["accuracy"],
            "confusion_matrix": [[r["tn"], r["fp"]], [r["fn"], r["tp"]]],
        }
        for r in evaluate.fold_metrics(scored, label, "prediction", FOLD).collect()
    }
    running = evaluate.running_counts(test, label, "probability")
    area = evaluate.areas(running).first()
    found = {
        "auc": area["auc"],
        "auc_pr": area["auc_pr"] or 0.0,
        "log_loss": evaluate.log_loss(test, label, "probability").first()["log_loss"],
        "train_metrics": folds.get("train"),
        "test_metrics": folds["test"],
        "fpr": [], "tpr": [], "pr_precision": [], "pr_recall": [],
    }
    if with_curves:
        roc = evaluate.roc_points(running).orderBy(F.desc("threshold")).toPandas()
        pr = evaluate.pr_points(running).orderBy("threshold").toPandas()
        found.update(
            fpr=roc["fpr"].tolist(), tpr=roc["tpr"].tolist(),
            pr_precision=pr["precision"].tolist(), pr_recall=pr["recall"].tolist(),
        )
    return found


@dataclass(frozen=True)
class Scored:
    """A fitted experiment: its staged scores of both folds, and the seconds of its stages."""

    experiment: Experiment
    rows: DataFrame
    prep_seconds: float
    fit_seconds: float
    predict_seconds: float
    adapter: dict[str, float] | None

    @property
    def total(self) -> float:
        fitting = sum(self.adapter.values()) if self.adapter else self.fit_seconds
        return self.prep_seconds + self.predict_seconds + fitting

    def facts(self) -> tuple:
        """A row of FACTS."""
        times = (self.prep_seconds, None if self.adapter else self.fit_seconds, self.predict_seconds)
        data, algorithm = self.experiment.data, self.experiment.algorithm
        return (
            self.experiment.name, run_name(data, algorithm, self.experiment.classifier), self.total, times,
            list((self.adapter or {}).items()),
        )


FACTS = (
    "experiment string, model_name string, training_time_seconds double, "
    "times struct<data_prep:double, fit:double, predict:double>, adapter array<struct<name:string, seconds:double>>"
)


def fit_and_score(experiment: Experiment, prepared: Prepared, prep_seconds: float) -> Scored:
    """Scores are written at the end of the predict stage, so lazy work is charged to its own stage."""
    data, label = prepared.data, prepared.label
    began = time.perf_counter()
    model = fit_model(
        experiment.algorithm, prepared.train, KEY, label, prepared.features, experiment.classifier
    )
    fit_seconds = time.perf_counter() - began
    if experiment.data.model_file:
        save_model(data.sparkSession, model, experiment.data.model_file)
    began = time.perf_counter()
    rows = stage_table(model.score(data).select(KEY, FOLD, label, "probability", "prediction"), "scores")
    return Scored(
        experiment, rows, prep_seconds, fit_seconds, time.perf_counter() - began, getattr(model, "timing", None)
    )


def evaluate_runs(scored: Sequence[Scored], label: str, store: str | None) -> DataFrame:
    """Rows in the format of saved runs, of many experiments on one preparation.

    All scores are one long table, so the number of jobs does not grow with the
    experiments.  With a ``store`` the curves go there as tables, whatever their length;
    else they are arrays of the row.
    """
    by = ["experiment"]
    long = reduce(DataFrame.unionByName, [s.rows.withColumn("experiment", F.lit(s.experiment.name)) for s in scored])
    test = long.where(F.col(FOLD) == "test").select("experiment", label, "probability")
    evaluate.require_two_classes(test, label, by)
    running = evaluate.running_counts(test, label, "probability", by)
    rates = evaluate.fold_metrics(long, label, "prediction", FOLD, by)
    metrics = rates.select("experiment", FOLD, evaluate.metrics_struct(F.col(FOLD)).alias("m")).groupBy(*by).agg(
        *[F.first(F.when(F.col(FOLD) == f, F.col("m")), True).alias(f"{f}_metrics") for f in ("train", "test")]
    )
    found = evaluate.areas(running, by).join(evaluate.log_loss(test, label, "probability", by), by).join(metrics, by)
    empty = F.array().cast("array<double>")
    if store is None:
        found = found.join(evaluate.curve_arrays(running, by), by)
    else:
        write_curves(evaluate.roc_points(running, by), evaluate.pr_points(running, by), store)
        found = found.withColumns({c: empty for c in ("fpr", "tpr", "pr_precision", "pr_recall")})
    facts = long.sparkSession.createDataFrame([s.facts() for s in scored], FACTS)
    timing = F.struct("times.data_prep", "times.fit", "times.predict", F.map_from_entries("adapter").alias("adapter"))
    whole = facts.join(found, by).withColumn("timing", timing).withColumn("auc_pr", F.coalesce("auc_pr", F.lit(0.0)))
    fields = T.StructType.fromDDL(RUN_SCHEMA).fields
    return whole.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], "experiment")


def run_prepared(experiment: Experiment, prepared: Prepared, prep_seconds: float, store: str | None = None) -> DataFrame:
    """Fit, score and evaluate; one row in the format of a saved run."""
    scored = fit_and_score(experiment, prepared, prep_seconds)
    return stage_table(evaluate_runs([scored], prepared.label, store), "run")


def run_experiment(
    spark: SparkSession, experiment: Experiment, table: DataFrame | None = None, store: str | None = None
) -> DataFrame:
    """One experiment on its own files, or on ``table`` when given; long curves belong in a ``store``."""
    prepared, seconds = _timed_prepare(spark, experiment.data, table)
    return run_prepared(experiment, prepared, seconds, store)


def _timed_prepare(
    spark: SparkSession, cfg: DataConfig, table: DataFrame | None
) -> tuple[Prepared, float]:
    began = time.perf_counter()
    prepared = prepare_files(spark, cfg) if table is None else prepare(table, cfg)
    return prepared, time.perf_counter() - began


def run_grid(
    spark: SparkSession,
    experiments: Iterable[Experiment],
    store: str,
    table: DataFrame | None = None,
    rerun: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """Run every experiment that has no saved run; returns the runs of the grid.

    Runs are saved as narrow rows, their curves as tables beside them (``read_curves``).
    Experiments with equal data settings share one preparation and are evaluated
    together, TOGETHER at a time.  With
    ``dry_run`` nothing is fitted; the rows per fold and label are returned.
    """
    wanted = list(experiments)
    names = spark.createDataFrame([(e.name,) for e in wanted], "experiment string")
    left = names
    if not rerun and _exists(spark, store):
        left = skip_finished(names, read_run_store(spark, store))
    todo = {r["experiment"] for r in left.collect()}
    groups: dict[DataConfig, list[Experiment]] = {}
    for e in wanted:
        if e.name in todo:
            groups.setdefault(_shared(e.data), []).append(e)
    counts: list[DataFrame] = []
    for members in groups.values():
        prepared, seconds = _timed_prepare(spark, members[0].data, table)
        if dry_run:
            counts += [prepared.counts().withColumn("experiment", F.lit(e.name)) for e in members]
        for at in range(0, 0 if dry_run else len(members), TOGETHER):
            _run_group(members[at : at + TOGETHER], prepared, seconds, store)
    if dry_run:
        result = counts[0] if counts else spark.createDataFrame([], "experiment string")
        for c in counts[1:]:
            result = result.unionByName(c)
        return result
    return read_run_store(spark, store).join(names, "experiment", "left_semi")


def _run_group(members: Sequence[Experiment], prepared: Prepared, seconds: float, store: str) -> None:
    """Fit and score one after the other, evaluate and save together; what was scored is saved if a later fit fails."""
    scored: list[Scored] = []
    try:
        for e in members:
            scored.append(fit_and_score(e, prepared, seconds))
    finally:
        if scored:
            write_runs(evaluate_runs(scored, prepared.label, store), store)


def _shared(cfg: DataConfig) -> DataConfig:
    """The settings that matter for the folds."""
    return replace(cfg, model_file=None, model_name_override=None)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("experiment string").json(path).limit(1).collect()
    except Exception as error:  # noqa: BLE001 - Spark names a missing path in the message
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True
