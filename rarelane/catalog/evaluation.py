"""Confusion counts, rates, curves, areas and log loss of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarelane.catalog.registry import query, r6, table
from rarelane.operators import evaluate


def scored(spark, folder):
    """Line items with a label, a coarse score, a fine score and a prediction."""
    coarse = F.round(F.col("l_discount") * 100) + F.col("l_quantity") % 7
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("fold"),
        coarse.alias("coarse"),
        F.col("l_extendedprice").alias("fine"),
        (coarse / 20).alias("p"),
        F.when(coarse / 20 > 0.4, 1).otherwise(-1).alias("prediction"),
    )


SCORED = """sc AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y,
         CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS fold,
         round(l_discount * 100) + l_quantity % 7 AS coarse, l_extendedprice AS fine,
         (round(l_discount * 100) + l_quantity % 7) / 20 AS p,
         CASE WHEN (round(l_discount * 100) + l_quantity % 7) / 20 > 0.4 THEN 1 ELSE -1 END AS prediction
  FROM lineitem)"""

_COUNTS = """count_if(y = 0 AND prediction = -1) AS tn, count_if(y = 0 AND prediction = 1) AS fp,
  count_if(y = 1 AND prediction = -1) AS fn, count_if(y = 1 AND prediction = 1) AS tp"""


def running_sql(src: str, score: str) -> str:
    """CTE ``run``: counts so far per distinct score, highest first."""
    return f"""
c AS (SELECT {score} AS score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {src} GROUP BY 1),
run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap,
          sum(neg) OVER () AS an, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg,
          row_number() OVER w AS rn, lag(pos) OVER w AS lpos
        FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("confusion", f"WITH {SCORED} SELECT fold, {_COUNTS} FROM sc GROUP BY 1")
def confusion(spark, folder):
    return evaluate.confusion(scored(spark, folder), "y", "prediction", ["fold"])


@query("prf_metrics", f"""
WITH {SCORED}, c AS (SELECT fold, {_COUNTS} FROM sc GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT fold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
             ELSE 0 END, 6) AS f1,
       round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM r""")
def prf_metrics(spark, folder):
    """Rates of both folds from one aggregate."""
    rates = evaluate.fold_metrics(scored(spark, folder), "y", "prediction")
    names = ["precision", "recall", "f1", "accuracy"]
    return rates.select("fold", *[r6(c).alias(c) for c in names])


_ROC = """
SELECT round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr, score AS threshold FROM run
WHERE rn = 1 OR npos IS NULL OR pos <> npos OR neg <> nneg
UNION ALL SELECT 0.0, 0.0, 'infinity'::DOUBLE"""


def _roc(df, score, range_rows):
    running = evaluate.running_counts(df, "y", score, range_rows=range_rows)
    return evaluate.roc_points(running).select(
        r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), "threshold"
    )


@query("roc_curve", f"WITH {SCORED}, {running_sql('sc', 'coarse')} {_ROC}")
def roc_curve(spark, folder):
    """Few distinct scores with many rows each."""
    return _roc(scored(spark, folder), "coarse", evaluate.RANGE_ROWS)


@query("roc_curve_fine", f"WITH {SCORED}, {running_sql('sc', 'fine')} {_ROC}")
def roc_curve_fine(spark, folder):
    """Many distinct scores, summed in score ranges; inner points thinned across ranges."""
    return _roc(scored(spark, folder), "fine", 5_000)


@query("auc_roc", f"""
WITH {SCORED}, {running_sql('sc', 'coarse')}
SELECT round(sum(neg * (tp - pos / 2)) / (max(ap) * max(an)), 6) AS auc FROM run""")
def auc_roc(spark, folder):
    running = evaluate.running_counts(scored(spark, folder), "y", "coarse")
    return evaluate.areas(running).select(r6("auc").alias("auc"))


@query("pr_curve", f"""
WITH {SCORED}, {running_sql('sc', 'fine')}
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall, score AS threshold FROM run
UNION ALL SELECT 1.0, 0.0, 'infinity'::DOUBLE""")
def pr_curve(spark, folder):
    running = evaluate.running_counts(scored(spark, folder), "y", "fine", range_rows=5_000)
    return evaluate.pr_points(running).select(
        r6("precision").alias("precision"), r6("recall").alias("recall"), "threshold"
    )


@query("auc_pr", f"""
WITH {SCORED}, {running_sql('sc', 'coarse')},
s AS (SELECT pos, tp / (tp + fp) AS p,
        coalesce(lag(tp / (tp + fp)) OVER (ORDER BY score DESC), 1) AS before, ap FROM run)
SELECT round(sum(pos / ap * (p + before) / 2), 6) AS auc_pr FROM s""")
def auc_pr(spark, folder):
    """Trapezoid from (recall 0, precision 1)."""
    running = evaluate.running_counts(scored(spark, folder), "y", "coarse")
    return evaluate.areas(running).select(r6("auc_pr").alias("auc_pr"))


@query("log_loss", f"""
WITH {SCORED}, c AS (SELECT fold, y, least(greatest(p, 2.220446049250313e-16),
                       1 - 2.220446049250313e-16) AS q FROM sc)
SELECT fold, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss
FROM c GROUP BY 1""")
def log_loss(spark, folder):
    """Probabilities of exactly 0 occur and are clipped."""
    losses = evaluate.log_loss(scored(spark, folder), "y", "p", ["fold"])
    return losses.select("fold", r6("log_loss").alias("log_loss"))
