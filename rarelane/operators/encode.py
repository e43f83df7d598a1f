"""Smoothed target encoding of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rarelane.session import stage_table

SMOOTHING = 10.0
# Category maps are broadcast, smallest first, while all of them together take at most so
# many bytes; larger ones are shuffled, with only their frequent short categories broadcast.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 48
FREQUENT_SHARE = 1000
FREQUENT_BYTES = 1024
SPREAD = 1024


def fit_target_encoding(
    df: DataFrame, columns: Sequence[str], label: str, smoothing: float = SMOOTHING, unseen: bool = False
) -> DataFrame:
    """Staged table ``(column, category, n, encoded)`` for all columns in one pass.

    With ``unseen``, a column has a row without a category too (n is 0): the value of a
    category that the table does not know, whose smoothed share is that of all rows.

    The columns are unpivoted, so one partial aggregation (which also folds hot
    categories before the shuffle) serves them all.  Totals and ranges per
    column come from the grouped table and have one row per column.
    """
    stats = (
        df.select(
            F.col(label).cast("double").alias("__y"),
            *[F.col(c).cast("string").alias(c) for c in columns],
        )
        .unpivot("__y", list(columns), "column", "category")
        .groupBy("column", "category")
        .agg(F.count("__y").alias("n"), F.sum("__y").alias("positives"))
    )
    # Staged: shares of all rows, ranges and categories are read from it, not from the rows again.
    stats = stage_table(stats, "categories")
    prior = stats.groupBy("column").agg(
        (F.sum("positives") / F.sum("n")).alias("prior")
    )
    smooth = (
        stats.where(F.col("category").isNotNull())
        .join(F.broadcast(prior), "column")
        .select(
            "column",
            "category",
            "n",
            ((F.col("positives") + smoothing * F.col("prior")) / (F.col("n") + smoothing)).alias(
                "smoothed"
            ),
        )
    )
    span = smooth.groupBy("column").agg(
        F.min("smoothed").alias("lo"), F.max("smoothed").alias("hi")
    )
    known = smooth.select("column", "category", "n", "smoothed")
    none = prior.select("column", F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("n"), F.col("prior").alias("smoothed"))
    # Staged: every later pass over the rows looks categories up in this table.
    unit = (F.col("smoothed") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    table = (known.unionByName(none) if unseen else known).join(F.broadcast(span), "column").select(
        "column",
        "category",
        "n",
        F.when(F.col("hi") > F.col("lo"), unit).otherwise(F.col("smoothed")).alias("encoded"),
    )
    return stage_table(table, "encoding")


def apply_target_encoding(
    df: DataFrame,
    mapping: DataFrame,
    columns: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    fill_unseen: bool = False,
) -> DataFrame:
    """Replace each column by its encoded value; NULL gives NULL.

    A category that the mapping does not know gives NULL, or with ``fill_unseen`` the
    value that the mapping has for such (``unseen``).
    """
    size = F.octet_length("category") + ROW_BYTES
    sizes = {
        r["column"]: r
        for r in mapping.groupBy("column")
        .agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.sum("n").alias("rows"),
             F.max(F.when(F.col("category").isNull(), F.col("encoded"))).alias("unseen"))
        .collect()
    }
    order, left, broadcast = df.columns, broadcast_bytes, set()
    for c in sorted(columns, key=lambda c: sizes[c]["bytes"] if c in sizes else 0):
        left -= sizes[c]["bytes"] if c in sizes else 0
        if left >= 0:
            broadcast.add(c)
    for c in columns:
        part = mapping.where((F.col("column") == c) & F.col("category").isNotNull()).select("category", "n", "encoded")
        kept = df.withColumn("__given", F.col(c).isNotNull()) if fill_unseen else df
        if c in broadcast:
            df = _lookup_broadcast(kept, part, c)
        else:
            df = _lookup_shuffled(kept, part, c, sizes[c]["rows"])
        if fill_unseen:
            unseen = F.lit(sizes[c]["unseen"] if c in sizes else None).cast("double")
            df = _swap(df, c, F.coalesce(F.col(c), F.when(F.col("__given"), unseen)), ["__given"])
    return df.select(*order)


def _swap(df: DataFrame, column: str, value: Column, extra: Sequence[str]) -> DataFrame:
    return df.withColumn(column, value).drop(*extra)


def _lookup_broadcast(df: DataFrame, part: DataFrame, column: str) -> DataFrame:
    part = part.select(F.col("category").alias("__cat"), F.col("encoded").alias("__enc"))
    joined = df.join(F.broadcast(part), F.col(column).cast("string") == F.col("__cat"), "left")
    return _swap(joined, column, F.col("__enc"), ["__cat", "__enc"])


def _lookup_shuffled(df: DataFrame, part: DataFrame, column: str, rows: int) -> DataFrame:
    """Left join with a map too large to broadcast.

    At most ``FREQUENT_SHARE`` categories can each hold 1/1000 of the rows; those of at most
    FREQUENT_BYTES are broadcast.  Rows they serve, and rows with a NULL, need nothing from the
    shuffled map, so they get a spread key that matches no map row instead of
    piling up in one task.
    """
    floor = max(rows // FREQUENT_SHARE, 1)
    frequent = (F.col("n") > floor) & (F.octet_length("category") <= FREQUENT_BYTES)
    hot = part.where(frequent).select(
        F.col("category").alias("__hot"), F.col("encoded").alias("__hot_enc")
    )
    cold = part.where(~frequent).select(
        F.col("category").alias("__cat"), F.lit(0).alias("__slot"), F.col("encoded").alias("__enc")
    )
    text = F.col(column).cast("string")
    carried = df.join(F.broadcast(hot), text == F.col("__hot"), "left")
    served = F.col("__hot").isNotNull() | F.col(column).isNull()
    # by place, not by content: equal rows must not meet in one task
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int") + 1
    carried = carried.withColumn("__spread", F.when(served, spread).otherwise(F.lit(0)))
    joined = carried.join(
        cold,
        (F.coalesce(text, F.lit("")) == F.col("__cat")) & (F.col("__spread") == F.col("__slot")),
        "left",
    )
    value = F.coalesce("__hot_enc", "__enc")
    return _swap(joined, column, value,
                 ["__hot", "__hot_enc", "__spread", "__cat", "__slot", "__enc"])
