"""Cleaning: NaN to NULL, prefixes, column roles, duplicates, log of the amount."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from rarelane.functions.text import double, quoted

PREFIX = "V"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in floating columns; NULL is the only missing value."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.selectExpr(*[
        f"CASE WHEN NOT isnan({quoted(c)}) THEN {quoted(c)} END AS {quoted(c)}"
        if c in floating else quoted(c)
        for c in df.columns
    ])


def categorical_columns(df: DataFrame, label: str, ignored: Sequence[str] = ()) -> list[str]:
    """Text, boolean and date columns that are neither label nor ignored."""
    kinds = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, kinds) and f.name != label and f.name not in ignored
    ]


def prefix_features(df: DataFrame, label: str, ignored: Sequence[str] = ()) -> DataFrame:
    """Rename every feature that lacks the ``V`` prefix to ``V_<name>``."""
    renames = {
        c: f"V_{c}"
        for c in df.columns
        if c != label and c not in ignored and not c.startswith(PREFIX)
    }
    taken = {c.lower() for c in df.columns}
    clash = [new for new in renames.values() if new.lower() in taken]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    return df.withColumnsRenamed(renames) if renames else df


def v_columns(df: DataFrame, label: str, ignored: Sequence[str] = ()) -> list[str]:
    """The V features in table order, read from the schema (no job)."""
    return [c for c in df.columns if c.startswith(PREFIX) and c != label and c not in ignored]


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Keep rows without NULL or NaN in any column."""
    return df.na.drop()


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of rows equal in all columns."""
    return df.dropDuplicates()


def log_amount(df: DataFrame, column: str) -> DataFrame:
    """log(1 + x) with negative amounts taken as 0; skipped without the column."""
    if column not in df.columns:
        return df
    x = F.col(column)
    return df.withColumn(column, F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x.cast("double"))))


def project_features(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Only the model inputs (as doubles) and the columns named in ``extra``."""
    return df.selectExpr(
        *map(quoted, extra), *[f"{double(c)} AS {quoted(c)}" for c in features]
    )

