"""Label expressions: yes/no text to 0/1, 0/1 to -1/+1 and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The words accepted as a boolean label.
TRUE_WORDS = ["yes", "true", "1", "y", "t"]
FALSE_WORDS = ["no", "false", "0", "n", "f"]


def word_to_binary(col: Column) -> Column:
    """1 for a true word, 0 for a false word, NULL for anything else."""
    word = F.lower(F.trim(col.cast("string")))
    return F.when(word.isin(TRUE_WORDS), 1).when(word.isin(FALSE_WORDS), 0)


def encode_label(df: DataFrame, label: str) -> DataFrame:
    """Turn a text or boolean label column into integer 0/1.

    Numeric columns pass unchanged.  Text is converted only when every value is
    a known word (one aggregate decides); a NULL among text labels is an error.
    """
    kind = df.schema[label].dataType
    if isinstance(kind, T.NumericType):
        return df
    col = F.col(label)
    if isinstance(kind, T.BooleanType):
        return df.withColumn(label, col.cast("int"))
    seen = df.agg(
        F.count_if(col.isNull()).alias("missing"),
        F.count_if(col.isNotNull() & word_to_binary(col).isNull()).alias("unknown"),
    ).first()
    if seen["missing"]:
        raise ValueError(f"label column {label!r} holds {seen['missing']} NULL values")
    if seen["unknown"]:
        return df
    return df.withColumn(label, word_to_binary(col))


def to_signed(col: Column) -> Column:
    """0/1 to -1/+1; any other value becomes NULL."""
    return F.when(col == 0, -1).when(col == 1, 1)


def to_binary(col: Column) -> Column:
    """-1/+1 to 0/1."""
    return F.when(col == 1, 1).otherwise(0)


def label_problems(df: DataFrame, label: str, allowed: Sequence[int]) -> DataFrame:
    """``value, n``: labels outside ``allowed``, as text, and how many rows hold each; NULL is one."""
    wrong = ~F.coalesce(F.col(label).isin(*allowed), F.lit(False))
    return df.where(wrong).groupBy(F.col(label).cast("string").alias("value")).agg(F.count("*").alias("n"))


def check_signed_labels(df: DataFrame, label: str) -> DataFrame:
    """Raise unless every label is -1 or +1."""
    bad = label_problems(df, label, (-1, 1)).orderBy(F.desc("n"), "value").limit(5).collect()
    if bad:
        raise ValueError(f"labels must be -1 or +1, found {[r['value'] for r in bad]}")
    return df
