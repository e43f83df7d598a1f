"""The whole way from a raw table to folds ready for a model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rarelane.config import DataConfig
from rarelane.functions.labels import encode_label, label_problems
from rarelane.functions.rowwise import add_row_aggregates
from rarelane.functions.text import quoted
from rarelane.operators import clean, encode, sample, scale
from rarelane.operators.oversample import new_rows
from rarelane.session import stage_table
from rarelane.sources.tables import read_inputs

KEY = "row_id"
FOLD = "fold"


@dataclass(frozen=True)
class Prepared:
    """One table: ``row_id``, the 0/1 label, ``fold`` and the model inputs."""

    data: DataFrame
    label: str
    features: tuple[str, ...]

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col(FOLD) == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col(FOLD) == "test")

    def counts(self) -> DataFrame:
        return self.data.groupBy(FOLD, self.label).agg(F.count(F.lit(1)).alias("n"))


def labelled(df: DataFrame, cfg: DataConfig) -> DataFrame:
    return encode_label(clean.nan_to_null(df), cfg.class_name)


def engineer(df: DataFrame, cfg: DataConfig, fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Category encoding, prefixes and row aggregates of labelled rows; returns the feature list.

    Category values are learnt from ``fit_on``, or from all rows; a category that only
    other rows hold then has the value of one without rows.
    """
    label, ignored = cfg.class_name, [*cfg.additional_feature_names, cfg.index_column, KEY, FOLD]
    for c in cfg.additional_feature_names:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError(f"additional feature {c!r} must be numeric")
    categories = clean.categorical_columns(df, label, ignored)
    if categories:
        mapping = encode.fit_target_encoding(df if fit_on is None else fit_on, categories, label, unseen=fit_on is not None)
        df = encode.apply_target_encoding(df, mapping, categories, fill_unseen=fit_on is not None)
    df = clean.prefix_features(df, label, ignored)
    v = clean.v_columns(df, label, ignored)
    if cfg.enable_engineered_features:
        df = add_row_aggregates(df, v)
    features = [*v, *cfg.engineered_feature_names, *cfg.additional_feature_names]
    return df, features


def clean_rows(df: DataFrame, cfg: DataConfig) -> DataFrame:
    if cfg.drop_duplicates:
        df = clean.drop_duplicate_rows(df)
    if cfg.log_transform_amount:
        df = clean.log_amount(df, cfg.amount_column)
    return df


def add_row_id(df: DataFrame, index_column: str) -> DataFrame:
    """Text key of a row, never shared: its index, or a digest of all columns.

    A row whose index is NULL or stands in several rows (two files each counted from
    0) gets a digest key like the rows of a table without an index.  Equal rows are
    counted and unfolded with a number, so each gets a key of its own however many
    copies there are.
    """
    if index_column not in df.columns:
        return _digest_keys(df)
    index = F.col(index_column).cast("string")
    repeated = stage_table(
        df.groupBy(index.alias("__index")).agg(F.count(F.lit(1)).alias("__n"))
        .where("__n > 1 OR __index IS NULL").select("__index"),
        "repeated",
    )
    keyed = df.withColumn(KEY, index)
    if repeated.isEmpty():
        return keyed
    # rows without an index need no join, which would bring all of them to one task
    known, bare = keyed.where(F.col(KEY).isNotNull()), keyed.where(F.col(KEY).isNull())
    same = known[KEY] == repeated["__index"]
    alone = known.join(repeated, same, "left_anti")
    shared = known.join(repeated, same, "left_semi").unionByName(bare).drop(KEY)
    return alone.unionByName(_digest_keys(shared))


def _digest_keys(df: DataFrame) -> DataFrame:
    columns = df.columns
    packed = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__times"))
    numbered = sample.unfold(packed, "__times", "__copy")
    parts = ", ".join(f"coalesce(cast({quoted(c)} as string), '?')" for c in columns)
    digest = F.expr(f"md5(concat_ws('|', {parts}))")
    return numbered.withColumn(KEY, F.concat_ws("#", digest, F.col("__copy"))).drop("__copy")


def split(df: DataFrame, cfg: DataConfig) -> DataFrame:
    if cfg.split_method == "chronological":
        return sample.split_chronological(
            df, cfg.time_column, [KEY], cfg.seed("split"), cfg.test_size, FOLD
        )
    return sample.split_random(
        df, cfg.class_name, [KEY], cfg.seed("split"), cfg.test_size, FOLD
    )


def balance(df: DataFrame, cfg: DataConfig) -> DataFrame:
    """Class sample when switched on, then the cap on all rows."""
    seed = cfg.seed("sample")
    if cfg.balances_classes:
        df = sample.balance_classes(
            df, cfg.class_name, [KEY], seed, cfg.max_fraud_samples, cfg.negatives_wanted,
            cfg.class_balance_ratio,
        )
    return sample.cap_total(df, cfg.class_name, [KEY], seed, cfg.max_total_samples)


def make_folds(df: DataFrame, cfg: DataConfig) -> DataFrame:
    """Balanced and split rows, in one of two orders.

    By default rows are balanced (or, without balancing, rows with a NULL
    dropped) and then split.  With a natural test fold the split comes first and
    only train rows are balanced.
    """
    if not cfg.preserve_natural_test_distribution:
        if cfg.balances_classes:
            return split(balance(df, cfg), cfg)
        return split(balance(clean.drop_null_rows(df), cfg), cfg)
    folds = split(clean.drop_null_rows(df), cfg)
    if not cfg.balances_classes:
        return folds
    train = balance(folds.where(F.col(FOLD) == "train"), cfg)
    return train.unionByName(folds.where(F.col(FOLD) == "test"))


def check_folds(df: DataFrame, label: str, features: Sequence[str]) -> None:
    """One aggregate: labels must be 0 or 1 and model inputs complete."""
    seen = df.selectExpr(
        f"count_if(NOT coalesce({quoted(label)} IN (0, 1), false)) AS __labels",
        *[f"count_if({quoted(f)} IS NULL) AS {quoted(f)}" for f in features],
    ).first().asDict()
    if seen.pop("__labels"):
        found = label_problems(df, label, (0, 1)).orderBy(F.desc("n"), "value").limit(5).collect()
        raise ValueError(f"labels in {label!r} must be 0 or 1, found {[r['value'] for r in found]}")
    missing = {f: n for f, n in seen.items() if n}
    if missing:
        raise ValueError(f"NULL values in model inputs: {missing}")


def prepare(df: DataFrame, cfg: DataConfig) -> Prepared:
    """Raw table to scaled, oversampled folds, staged in the shared folder.

    The keyed rows are written once: sample, cap and split then read key and label only.
    The folds are written once more; the new rows of oversampling are written beside them.
    """
    if cfg.encoding_fold == "train":
        rows = stage_table(add_row_id(clean_rows(labelled(df, cfg), cfg), cfg.index_column), "keyed")
        parts = stage_table(make_folds(rows, cfg), "parts")
        whole, features = engineer(parts, cfg, parts.where(F.col(FOLD) == "train"))
    else:
        engineered, features = engineer(labelled(df, cfg), cfg)
        rows = stage_table(add_row_id(clean_rows(engineered, cfg), cfg.index_column), "keyed")
        whole = make_folds(rows, cfg)
    folds = stage_table(clean.project_features(whole, features, [KEY, cfg.class_name, FOLD]), "folds")
    check_folds(folds, cfg.class_name, features)
    folds = scale.scale_folds(folds, features, cfg.feature_scaling, FOLD)
    if cfg.should_over_sample:
        train = folds.where(F.col(FOLD) == "train")
        made = new_rows(
            train, cfg.class_name, KEY, features, cfg.oversample_method, cfg.minority_ratio,
            cfg.seed("oversample"),
        ).withColumn(FOLD, F.lit("train"))
        folds = folds.unionByName(stage_table(made, "oversampled"))
    return Prepared(folds, cfg.class_name, tuple(features))


def prepare_files(spark: SparkSession, cfg: DataConfig) -> Prepared:
    return prepare(read_inputs(spark, cfg.train_file, cfg.test_file), cfg)
