"""Metrics and exact curves of scored rows, for one run or many at once.

Every function takes ``by``: the columns that name a run.  All runs of a grid are
scored into one long table and evaluated by the same few aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rarelane.functions.text import quoted
from rarelane.session import stage_table

# Fixed value: probabilities are clipped this far away from 0 and 1.
LOG_LOSS_EPSILON = 2.220446049250313e-16
# Running sums over more distinct scores than this are cut into score ranges.
RANGE_ROWS = 100_000
# Accuracy of the range ends; beyond it ranges are less even, not fewer.
MAX_ACCURACY = 10_000_000


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts ``tn fp fn tp`` per run; the positive label is 1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )


def add_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from the four counts; 0 when undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        counts.withColumn("precision", _share(tp, tp + fp))
        .withColumn("recall", _share(tp, tp + fn))
        .withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))
        .withColumn("accuracy", _share(tn + tp, tn + fp + fn + tp))
    )


def metrics_struct(split: str | Column) -> Column:
    """The counts and rates of one row as the saved metrics structure."""
    name = F.lit(split) if isinstance(split, str) else split
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return F.struct(
        name.alias("split"), "precision", "recall", "f1", "accuracy",
        matrix.alias("confusion_matrix"),
    )


def log_loss(df: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log likelihood of the positive-class probability."""
    p = F.greatest(
        F.least(F.col(probability), F.lit(1.0 - LOG_LOSS_EPSILON)), F.lit(LOG_LOSS_EPSILON)
    )
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log1p(-p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def _same(columns: Sequence[str]) -> Column:
    """Equal columns of the sides ``l`` and ``r``, whose names have two underscores before them."""
    return reduce(and_, [F.col(f"l.{quoted(c)}").eqNullSafe(F.col(f"r.{quoted('__' + c)}")) for c in columns])


def running_counts(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per run and distinct score with counts so far, highest score first.

    Columns: ``pos neg`` at this score, ``tp fp`` at or above it, ``all_pos
    all_neg`` of the run, ``next_pos next_neg`` of the next lower score (NULL at
    the last).  Equal scores are folded before the shuffle, so a score shared by
    a third of the rows costs one row per task.  When many distinct scores are
    left, they are cut into score ranges; each range is summed by itself and the
    totals of the ranges (few rows) supply what came before.
    """
    by = list(by)
    value = F.col(score).cast("double")
    sound = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("a score is NULL or NaN")).cast("double"))
    counts = df.groupBy(*by, sound.otherwise(value).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.coalesce(F.col(label) != 1, F.lit(True))).alias("neg"),
    )
    ranged = add_score_ranges(stage_table(counts, "scores"), range_rows)
    parts = [*by, "__range"]
    totals = ranged.groupBy(*parts).agg(
        F.sum("pos").alias("range_pos"),
        F.sum("neg").alias("range_neg"),
        F.max_by("pos", "score").alias("top_pos"),
        F.max_by("neg", "score").alias("top_neg"),
    )
    down = Window.partitionBy(*by).orderBy(F.desc("__range"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *[F.col(c).alias(f"__{c}") for c in parts],
        F.coalesce(F.sum("range_pos").over(before), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("range_neg").over(before), F.lit(0)).alias("neg_before"),
        F.sum("range_pos").over(whole).alias("all_pos"),
        F.sum("range_neg").over(whole).alias("all_neg"),
        F.lead("top_pos").over(down).alias("range_next_pos"),
        F.lead("top_neg").over(down).alias("range_next_neg"),
    )
    inside = Window.partitionBy(*parts).orderBy(F.desc("score"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*",
        F.sum("pos").over(so_far).alias("local_pos"),
        F.sum("neg").over(so_far).alias("local_neg"),
        F.lead("pos").over(inside).alias("lead_pos"),
        F.lead("neg").over(inside).alias("lead_neg"),
    )
    return local.alias("l").join(totals.alias("r"), _same(parts)).select(
        *by, "score", "pos", "neg",
        (F.col("pos_before") + F.col("local_pos")).alias("tp"),
        (F.col("neg_before") + F.col("local_neg")).alias("fp"),
        "all_pos", "all_neg",
        F.coalesce("lead_pos", "range_next_pos").alias("next_pos"),
        F.coalesce("lead_neg", "range_next_neg").alias("next_neg"),
    )


def add_score_ranges(counts: DataFrame, range_rows: int) -> DataFrame:
    """Add ``__range``: number score ranges of about ``range_rows`` distinct scores each."""
    scores = counts.count()
    ranges = -(-scores // range_rows)
    if ranges <= 1:
        return counts.withColumn("__range", F.lit(0))
    shares = [i / ranges for i in range(1, ranges)]
    found = counts.agg(
        F.percentile_approx("score", shares, min(100 * ranges, MAX_ACCURACY)).alias("ends")
    ).first()["ends"]
    ends = sorted(set(found))

    @F.pandas_udf("int")
    def number(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, values.to_numpy(), side="right").astype(np.int32))

    return counts.withColumn("__range", number("score"))


def roc_points(running: DataFrame, by: Sequence[str] = (), thin: bool = True) -> DataFrame:
    """ROC points ``fpr tpr threshold``; the start (0, 0) has an infinite threshold.

    With ``thin`` an inner point is left out when it lies in the middle of two
    equal steps: the counts at its score and at the next score are the same.
    """
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bends = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    kept = running.where(first | last | bends) if thin else running
    points = kept.select(
        *by,
        _share(F.col("fp"), F.col("all_neg")).alias("fpr"),
        _share(F.col("tp"), F.col("all_pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    start = running.where(first).select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"),
    )
    return start.unionByName(points)


def pr_points(running: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision-recall points, one per distinct score, plus (recall 0, precision 1)."""
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    points = running.select(
        *by,
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), F.col("all_pos")).alias("recall"),
        F.col("score").alias("threshold"),
    )
    end = running.where(first).select(
        *by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        F.lit(float("inf")).alias("threshold"),
    )
    return points.unionByName(end)


def curve_arrays(running: DataFrame, by: Sequence[str]) -> DataFrame:
    """Curves as arrays, one row per run: the form of a saved document.

    For runs with few distinct scores; long curves stay in the point tables.
    """

    def listed(points: DataFrame, order: Column, names: dict[str, str]) -> DataFrame:
        fields = F.struct(order.alias("o"), *names.values())
        packed = points.groupBy(*by).agg(F.array_sort(F.collect_list(fields)).alias("a"))
        return packed.select(*by, *[F.col("a")[v].alias(k) for k, v in names.items()])

    roc = listed(
        roc_points(running, by), -F.col("threshold"), {"fpr": "fpr", "tpr": "tpr"}
    )
    pr = listed(
        pr_points(running, by), F.col("threshold"),
        {"pr_precision": "precision", "pr_recall": "recall"},
    )
    return roc.join(pr, list(by))


def areas(running: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``auc`` and ``auc_pr`` per run, trapezoids over the unthinned curves.

    Both need only the counts before and after a score, so no neighbour lookup.
    A run with a single class has no ROC area (NULL).
    """
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    step = neg * (tp - pos / 2)
    precision = tp / (tp + fp)
    above = (tp - pos) + (fp - neg)
    previous = F.when(above > 0, (tp - pos) / F.when(above > 0, above)).otherwise(F.lit(1.0))
    strip = pos * (precision + previous) / 2
    p, n = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    return running.groupBy(*by).agg(
        F.try_divide(F.sum(step), p * n).alias("auc"),
        F.try_divide(F.sum(strip), p).alias("auc_pr"),
    )


def require_two_classes(df: DataFrame, label: str, by: Sequence[str] = ()) -> None:
    """Raise when a run's labels hold one class only."""
    lone = (
        df.groupBy(*by)
        .agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
        .where("p = 0 or n = 0")
        .limit(5)
        .collect()
    )
    if lone:
        raise ValueError(f"only one class present, ROC area is undefined: {lone}")


def fold_metrics(
    df: DataFrame, label: str, prediction: str, fold: str = "fold", by: Sequence[str] = ()
) -> DataFrame:
    """Counts and rates per run and fold in one aggregate."""
    return add_rates(confusion(df, label, prediction, [*by, fold]))
