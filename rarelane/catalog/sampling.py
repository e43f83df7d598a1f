"""Class counts, exact samples, splits, scaling, whole preparations, oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarelane.catalog.cleaning import _encode_sql
from rarelane.catalog.registry import (
    EVENTS, ORDERS, events, orders, query, r6, share_sql, split_sql, table,
)
from rarelane.config import DataConfig
from rarelane.estimators.logistic import class_weights
from rarelane.operators import oversample, sample, scale
from rarelane.plans import prepare


@query("class_counts", """
SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, count(*) AS n FROM lineitem GROUP BY 1""")
def class_counts(spark, folder):
    src = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    return sample.class_counts(src, "y")


@query("class_weights", """
SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, count(*) AS n,
       round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight
FROM lineitem GROUP BY 1""")
def balanced_weights(spark, folder):
    src = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    return class_weights(src, "y").withColumn("weight", r6("weight"))


@query("class_targets", f"""
WITH {ORDERS}, c AS (SELECT count_if(y = 1) AS p, count_if(y = 0) AS n FROM od),
t AS (SELECT 'all positives' AS setting, p AS pos, least(p, n) AS neg FROM c
UNION ALL SELECT 'ratio 2.5', p, least(CAST(round_even(2.5 * p, 0) AS BIGINT), n) FROM c
UNION ALL SELECT 'limits', least(300, p), least(700, n) FROM c)
SELECT setting, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM t""")
def class_targets(spark, folder):
    """Rows wanted per class, from counts."""
    counts = {r["y"]: r["n"] for r in sample.class_counts(orders(spark, folder), "y").collect()}
    p, n = counts.get(1, 0), counts.get(0, 0)
    settings = [
        ("all positives", sample.resolve_class_targets(p, n)),
        ("ratio 2.5", sample.resolve_class_targets(p, n, ratio=2.5)),
        ("limits", sample.resolve_class_targets(p, n, 300, 700)),
    ]
    rows = [(name, *got) for name, got in settings]
    return spark.createDataFrame(rows, "setting string, pos bigint, neg bigint")


@query("class_balanced_sample", f"""
WITH {ORDERS}, c AS (SELECT count_if(y = 1) AS p, count_if(y = 0) AS n FROM od),
r AS (SELECT od.*, row_number() OVER (PARTITION BY y
        ORDER BY md5('sample|7|' || CAST(o_orderkey AS VARCHAR))) AS rn FROM od)
SELECT o_orderkey, y, o_totalprice FROM r, c
WHERE CASE WHEN y = 1 THEN true ELSE rn <= least(CAST(round_even(0.5 * p, 0) AS BIGINT), n) END""")
def class_balanced_sample(spark, folder):
    """All positives and half as many negatives, exactly."""
    picked = sample.balance_classes(orders(spark, folder), "y", ["o_orderkey"], 7, ratio=0.5)
    return picked.select("o_orderkey", "y", "o_totalprice")


@query("stratified_cap", f"""
WITH {ORDERS}, {share_sql("sh", "od", "y", "least(rows_all, 1000)")},
r AS (SELECT od.*, row_number() OVER (PARTITION BY y
        ORDER BY md5('cap|42|' || CAST(o_orderkey AS VARCHAR))) AS rn FROM od)
SELECT o_orderkey, y FROM r JOIN sh ON g = y WHERE rn <= take""")
def stratified_cap(spark, folder):
    capped = sample.cap_total(orders(spark, folder), "y", ["o_orderkey"], 42, 1000)
    return capped.select("o_orderkey", "y")


@query("stratified_split", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")}
SELECT event_id, y, fold FROM folds""")
def stratified_split(spark, folder):
    src = events(spark, folder).select("event_id", "y")
    return sample.split_random(src, "y", ["event_id"], 42, 0.3)


_CHRONO = """
SELECT {cols}, CASE WHEN row_number() OVER (ORDER BY {time} NULLS LAST,
         md5('split|42|' || CAST({key} AS VARCHAR)))
       <= (SELECT count(*) - CAST(round_even(count(*) * 0.3, 0) AS BIGINT) FROM {src})
       THEN 'train' ELSE 'test' END AS fold
FROM {src}"""


@query("chronological_split", f"""
WITH {ORDERS} {_CHRONO.format(cols="o_orderkey, y", time="o_orderdate", key="o_orderkey", src="od")}""")
def chronological_split(spark, folder):
    """Days are shared by many orders, so the cut goes through a tie."""
    src = orders(spark, folder).select("o_orderkey", "y", "o_orderdate")
    return sample.split_chronological(src, "o_orderdate", ["o_orderkey"], 42, 0.3).drop("o_orderdate")


@query("scale_minmax", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},
st AS (SELECT min(value) AS a, max(value) - min(value) AS b, min(k) AS c, max(k) - min(k) AS d
       FROM folds WHERE fold = 'train')
SELECT event_id, fold, round((value - a) / b, 6) + 0.0 AS value, round((k - c) / d, 6) + 0.0 AS k
FROM folds, st""")
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@query("scale_standard", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},
st AS (SELECT avg(value) AS a, stddev_pop(value) AS b, avg(k) AS c, stddev_pop(k) AS d
       FROM folds WHERE fold = 'train')
SELECT event_id, fold, round((value - a) / b, 6) + 0.0 AS value, round((k - c) / d, 6) + 0.0 AS k
FROM folds, st""")
def scale_standard(spark, folder):
    return _scaled(spark, folder, "standard")


def _scaled(spark, folder, kind):
    src = events(spark, folder).select("event_id", "y", "value", "k")
    folds = sample.split_random(src, "y", ["event_id"], 42, 0.3)
    scaled = scale.scale_folds(folds, ["value", "k"], kind)
    return scaled.select("event_id", "fold", r6("value").alias("value"), r6("k").alias("k"))


_DRAW = "(CAST(('0x' || substr(md5('{tag}|42|' || {text}), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def _draw(tag: str, text: str = "CAST(i AS VARCHAR)") -> str:
    return _DRAW.format(tag=tag, text=text)


# ---- whole preparations ---------------------------------------------------

_ENGINEERED = f"""
{_encode_sql("ev", "user_name")},
f AS (SELECT event_id, CAST(event_id AS VARCHAR) AS row_id, y AS "Class", "at" AS "Time",
             e AS v1, value AS v2, k AS v3
      FROM ev LEFT JOIN enc ON user_name = c),
m AS (SELECT *, v1 + v2 + v3 AS s, (v1 + v2 + v3) / 3 AS mean FROM f),
eng AS (SELECT row_id, "Class", "Time", v1, v2, v3, s, least(v1, v2, v3) AS mn,
        greatest(v1, v2, v3) AS mx, mean,
        CAST(v1 > 0 AS INTEGER) + CAST(v2 > 0 AS INTEGER) + CAST(v3 > 0 AS INTEGER) AS pos,
        CAST(v1 < 0 AS INTEGER) + CAST(v2 < 0 AS INTEGER) + CAST(v3 < 0 AS INTEGER) AS neg,
        ((v1-mean)*(v1-mean) + (v2-mean)*(v2-mean) + (v3-mean)*(v3-mean)) / 3 AS var
        FROM m)"""

_PREP_COLUMNS = {
    "V_user_name": "v1", "V_value": "v2", "V_k": "v3", "Comp_Sum": "s", "Comp_Min": "mn",
    "Comp_Max": "mx", "Comp_Avg": "mean", "Comp_Std": "sqrt(var)", "Comp_Pos": "pos",
    "Comp_Neg": "neg", "Comp_Var": "var", "Time": '"Time"',
}


def _smote_sql(src: str) -> str:
    """Scaled rows of ``src`` and the new rows of SMOTE, whose distances are between scaled rows."""
    count = len(_PREP_COLUMNS)
    ends = ", ".join(
        f"min({e}) FILTER (WHERE fold = 'train') AS a{i}, max({e}) FILTER (WHERE fold = 'train') AS b{i}"
        for i, e in enumerate(_PREP_COLUMNS.values())
    )
    scaled = ", ".join(
        f"({e} - a{i}) / CAST(CASE WHEN b{i} > a{i} THEN b{i} - a{i} ELSE 1 END AS DOUBLE) AS f{i}"
        for i, e in enumerate(_PREP_COLUMNS.values())
    )
    apart = " + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(count))
    mates = ", ".join(f"b.f{i} AS m{i}" for i in range(count))
    old = ", ".join(f'round(f{i}, 6) + 0.0 AS "{n}"' for i, n in enumerate(_PREP_COLUMNS))
    new = ", ".join(f"round(f{i} + {_draw('gap')} * (m{i} - f{i}), 6) + 0.0" for i in range(count))
    return f"""ends AS (SELECT {ends} FROM {src}),
sc AS MATERIALIZED (SELECT row_id, "Class", fold, {scaled} FROM {src}, ends),
counts AS (SELECT count_if("Class" = 1) AS small, count_if("Class" = 0) AS big FROM sc WHERE fold = 'train'),
pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('index|42|' || row_id)) - 1 AS base_index
  FROM sc WHERE fold = 'train' AND "Class" = 1),
numbers AS (SELECT i, CAST(floor({_draw("base")} * small) AS BIGINT) AS pick
            FROM counts, range((SELECT CAST(1.0 * big - small AS BIGINT) FROM counts)) t(i)),
mates AS MATERIALIZED (SELECT * FROM (SELECT a.row_id AS base_key, {mates},
    row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt({apart}), b.row_id) AS slot
  FROM pool a JOIN pool b ON a.row_id <> b.row_id) WHERE slot <= 5)
SELECT row_id, "Class", fold, {old} FROM sc
UNION ALL SELECT '+' || row_id || ':' || CAST(i AS VARCHAR), 1, 'train', {new}
FROM numbers JOIN pool ON pick = base_index
JOIN mates ON base_key = row_id AND slot = CAST(floor({_draw("mate")} * 5) AS BIGINT) + 1"""


def _prepared(spark, folder, **settings):
    src = events(spark, folder).select(
        F.col("event_id").alias("id"), "user_name", "value", "k", F.col("at").alias("Time"),
        F.when(F.col("y") == 1, "yes").otherwise("no").alias("Class"),
    )
    cfg = DataConfig(additional_feature_names=("Time",), feature_scaling="minmax", **settings)
    made = prepare.prepare(src, cfg)
    return made.data.select("row_id", "Class", "fold", *[r6(c).alias(c) for c in made.features])


def _sample_sql(out: str, src: str, limit: str) -> str:
    return f"""{out} AS (SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY "Class"
         ORDER BY md5('sample|42|' || row_id)) AS rn FROM {src} s)
  WHERE "Class" = 1 OR rn <= {limit})"""


@query("prep_default", f"""
WITH {EVENTS}, {_ENGINEERED},
pos AS (SELECT count_if("Class" = 1) AS p FROM eng),
{_sample_sql("picked", "eng", "(SELECT round_even(2.0 * p, 0) FROM pos)")},
{split_sql("folds", "picked", "row_id", '"Class"')}, {_smote_sql("folds")}""")
def prep_default(spark, folder):
    """Encode, engineer, balance, split, scale, oversample."""
    return _prepared(spark, folder, class_balance_ratio=2.0)


@query("prep_natural_test", f"""
WITH {EVENTS}, {_ENGINEERED},
{split_sql("parts", "eng", "row_id", '"Class"')},
train AS (SELECT * FROM parts WHERE fold = 'train'),
pos AS (SELECT count_if("Class" = 1) AS p FROM train),
{_sample_sql("picked", "train", "(SELECT round_even(1.5 * p, 0) FROM pos)")},
folds AS (SELECT * FROM picked UNION ALL SELECT * FROM parts WHERE fold = 'test'),
{_smote_sql("folds")}""")
def prep_natural_test(spark, folder):
    """Split first, balance and oversample the train fold only; the test fold stays as it is."""
    return _prepared(
        spark, folder, preserve_natural_test_distribution=True, class_balance_ratio=1.5
    )


@query("prep_train_encoding", f"""
WITH {EVENTS}, {split_sql("folds", "ev", "event_id")},
unlike AS (SELECT * REPLACE (CASE WHEN fold = 'train' AND user_name LIKE '%7' THEN '1' ELSE user_name END AS user_name) FROM folds),
learnt AS (SELECT * FROM unlike WHERE fold = 'train'), {_encode_sql("learnt", "user_name")}
SELECT CAST(event_id AS VARCHAR) AS row_id, y AS "Class", fold, round(coalesce(e, (g - lo) / (hi - lo)), 6) + 0.0 AS "V_user_name",
       value AS "V_value" FROM unlike LEFT JOIN enc ON user_name = c, prior, span""")
def prep_train_encoding(spark, folder):
    """Category values learnt from the train fold; names that end in 7 are unknown there."""
    src = sample.split_random(events(spark, folder), "y", ["event_id"], 42, 0.3)
    hidden = (F.col("fold") == "train") & F.col("user_name").endswith("7")
    src = src.select(
        F.col("event_id").alias("id"), F.when(hidden, "1").otherwise(F.col("user_name")).alias("user_name"),
        "value", F.col("y").alias("Class"),
    )
    cfg = DataConfig(
        encoding_fold="train", should_over_sample=False, enable_engineered_features=False, engineered_feature_names=()
    )
    made = prepare.prepare(src, cfg).data
    return made.select("row_id", "Class", "fold", r6("V_user_name").alias("V_user_name"), "V_value")


def _seeded_sample_sql(seed: int) -> str:
    return f"""picked AS (SELECT * EXCLUDE (rn) FROM (
  SELECT e.*, row_number() OVER (PARTITION BY y ORDER BY md5('sample|{seed}|' || CAST(event_id AS VARCHAR))) AS rn
  FROM ev e) WHERE y = 1 OR rn <= (SELECT round_even(1.5 * count_if(y = 1), 0) FROM ev))"""


@query("stage_seeds", f"""
WITH {EVENTS}, {_seeded_sample_sql(5)}, {split_sql("folds", "picked", "event_id", "y", 7)}
SELECT CAST(event_id AS VARCHAR) AS row_id, y, fold FROM folds""")
def stage_seeds(spark, folder):
    """Sample and split by seeds of their own; the common seed serves neither."""
    cfg = DataConfig(class_name="y", class_balance_ratio=1.5, random_state=1, sample_random_state=5, split_random_state=7)
    rows = prepare.add_row_id(events(spark, folder), "event_id")
    return prepare.make_folds(rows, cfg).select("row_id", "y", "fold")


# ---- oversampling ---------------------------------------------------------

_POOL = """
counts AS (SELECT count_if(y = 1) AS small, count_if(y = 0) AS big FROM ev),
pool AS (SELECT *, row_number() OVER (
           ORDER BY md5('index|42|' || CAST(event_id AS VARCHAR))) - 1 AS base_index
         FROM ev WHERE y = 1)"""
_NUMBERS = f"""
numbers AS (SELECT i, CAST(floor({_draw("base")} * small) AS BIGINT) AS pick
            FROM counts, range((SELECT CAST(1.0 * big - small AS BIGINT) FROM counts)) t(i))"""
_MATES = """
mates AS (SELECT * FROM (
  SELECT a.event_id AS base_key, b.event_id AS mate_key, b.value AS mate_value, b.k AS mate_k,
         row_number() OVER (PARTITION BY a.event_id ORDER BY
           sqrt((a.value-b.value)*(a.value-b.value) + (a.k-b.k)*(a.k-b.k)), b.event_id) AS slot
  FROM pool a JOIN pool b ON a.event_id <> b.event_id) WHERE slot <= 5)"""

_POINTS = ["value", "k"]


def _minority(spark, folder):
    return events(spark, folder).select("event_id", "y", *_POINTS)


@query("oversample_random", f"""
WITH {EVENTS}, {_POOL}, {_NUMBERS}
SELECT i, event_id AS base_key, value, k, y FROM numbers JOIN pool ON pick = base_index""")
def oversample_random(spark, folder):
    return oversample.random_rows(_minority(spark, folder), "y", "event_id", _POINTS, 1.0, 42)


@query("oversample_smote", f"""
WITH {EVENTS}, {_POOL}, {_NUMBERS}, {_MATES}
SELECT i, base_key, mate_key, round(value + {_draw("gap")} * (mate_value - value), 6) + 0.0 AS value,
       round(k + {_draw("gap")} * (mate_k - k), 6) + 0.0 AS k, y
FROM numbers JOIN pool ON pick = base_index
JOIN mates ON base_key = event_id AND slot = CAST(floor({_draw("mate")} * 5) AS BIGINT) + 1""")
def oversample_smote(spark, folder):
    made = oversample.smote_rows(_minority(spark, folder), "y", "event_id", _POINTS, 1.0, 42)
    return made.select("i", "base_key", "mate_key", r6("value").alias("value"), r6("k").alias("k"), "y")


_BOTH = "CAST(base_key AS VARCHAR) || '|' || CAST(i AS VARCHAR)"


@query("oversample_adasyn", f"""
WITH {EVENTS}, {_POOL}, {_MATES},
around AS (SELECT * FROM (
  SELECT a.event_id, b.y, row_number() OVER (PARTITION BY a.event_id ORDER BY
           sqrt((a.value-b.value)*(a.value-b.value) + (a.k-b.k)*(a.k-b.k)), b.event_id) AS slot
  FROM pool a JOIN ev b ON a.event_id <> b.event_id) WHERE slot <= 5),
hard AS (SELECT event_id AS key, count_if(y = 0) / CAST(5 AS DOUBLE) AS share FROM around GROUP BY 1),
wanted AS (SELECT key, CAST(round_even(share / (SELECT sum(share) FROM hard)
             * (SELECT CAST(1.0 * big - small AS BIGINT) FROM counts), 0) AS BIGINT) AS copies
           FROM hard),
made AS (SELECT key AS base_key, unnest(range(copies)) AS i FROM wanted),
drawn AS (SELECT *, {_draw("gap", _BOTH)} AS gap,
          CAST(floor({_draw("mate", _BOTH)} * 5) AS BIGINT) + 1 AS slot FROM made)
SELECT drawn.i, drawn.base_key, mate_key, round(value + gap * (mate_value - value), 6) + 0.0 AS value,
       round(k + gap * (mate_k - k), 6) + 0.0 AS k, y
FROM drawn JOIN pool ON event_id = drawn.base_key
JOIN mates ON mates.base_key = drawn.base_key AND mates.slot = drawn.slot""")
def oversample_adasyn(spark, folder):
    made = oversample.adasyn_rows(_minority(spark, folder), "y", "event_id", _POINTS, 1.0, 42)
    return made.select("i", "base_key", "mate_key", r6("value").alias("value"), r6("k").alias("k"), "y")
