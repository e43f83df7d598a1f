"""Oversampling of the minority class in the train fold.

New rows are numbered 0, 1, ...; everything random about row i is drawn from a
digest of i.  The numbers are joined to the minority rows by a dense index, so
the work is a join of evenly spread keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rarelane.functions.draws import order_hash, unit_draw
from rarelane.functions.text import double, quoted
from rarelane.operators.neighbours import Metric, nearest_lists
from rarelane.operators.sample import PREFIX_DIGITS, unfold
from rarelane.session import stage_table

# Fixed value: neighbours per minority row.
NEIGHBOURS = 5


def dense_index(df: DataFrame, key: Sequence[str], seed: int, into: str) -> DataFrame:
    """Number rows 0 .. n-1 in digest order without a global sort.

    Rows are counted per digest prefix (at most 4,096 groups); the running total
    of the groups plus the rank inside a group is the number.
    """
    hashed = df.withColumn("__h", order_hash("index", seed, key))
    hashed = hashed.withColumn("__p", F.substring("__h", 1, PREFIX_DIGITS))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy("__p").count().select(
        F.col("__p").alias("__q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o")
    )
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h", *key))
    ranked = hashed.withColumn("__r", rank)
    joined = ranked.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))
    return joined.withColumn(into, F.col("__o") + F.col("__r") - 1).drop(
        "__h", "__p", "__q", "__o", "__r"
    )


def rows_to_add(minority: int, majority: int, ratio: float) -> int:
    """New minority rows for the wanted ratio; a ratio already passed is an error."""
    wanted = int(ratio * majority - minority)
    if wanted < 0:
        raise ValueError(
            f"ratio {ratio} asks for fewer minority rows than present ({minority} of {majority})"
        )
    return wanted


def _minority(train: DataFrame, label: str) -> tuple[int, int, int]:
    """(minority label, its rows, rows of the majority)."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(counts) != 2:
        raise ValueError(f"oversampling needs two classes, found {sorted(counts)}")
    small = min(counts, key=lambda g: (counts[g], -g))
    return small, counts[small], sum(counts.values()) - counts[small]


def _doubles(features: Sequence[str]) -> list[Column]:
    return [F.expr(double(f)).alias(f) for f in features]


def _numbers(df: DataFrame, n: int, rows: int, seed: int) -> DataFrame:
    """``i`` = 0 .. n-1 with the index of the minority row each one starts from."""
    pick = F.floor(unit_draw("base", seed, F.col("i")) * rows)
    return df.sparkSession.range(n).select(F.col("id").alias("i")).withColumn("base_index", pick)


def random_rows(
    train: DataFrame, label: str, key: str, features: Sequence[str], ratio: float, seed: int
) -> DataFrame:
    """Copies of minority rows drawn with replacement: ``i, source key, features``."""
    small, rows, others = _minority(train, label)
    n = rows_to_add(rows, others, ratio)
    pool = dense_index(train.where(F.col(label) == small).select(key, *features), [key], seed,
                       "base_index")
    drawn = _numbers(train, n, rows, seed).join(pool, "base_index")
    return drawn.select("i", F.col(key).alias("base_key"), *features, F.lit(small).alias(label))


def _pool(rows: DataFrame) -> DataFrame:
    """Staged minority rows, each with a number ``__row`` of its own: keys may repeat."""
    return stage_table(rows.withColumn("__row", F.monotonically_increasing_id()), "pool")


def _with_neighbours(
    pool: DataFrame, key: str, features: Sequence[str], k: int
) -> DataFrame:
    """Minority rows with the numbers of their k nearest minority rows, nearest first."""
    near = nearest_lists(
        pool, pool, key, [features], k, Metric(2.0), carry=["__row"], skip_self=True
    )
    return pool.drop("__row").join(
        near.select(F.col(key).alias("__key"), "near"), F.col(key) == F.col("__key")
    ).drop("__key")


def _between(drawn: DataFrame, pool: DataFrame, key: str, features: Sequence[str], small: int, label: str) -> DataFrame:
    """Points on the segment from the row to its neighbour number ``__slot`` (from 1).

    The neighbour's features are joined by its number, so the lists of neighbours need not carry them.
    """
    mates = pool.select(
        F.col("__row").alias("__mate_row"), *[F.col(f).alias(f"__mate_{i}") for i, f in enumerate(features)]
    )
    picked = drawn.withColumn("__mate", F.element_at("near", F.col("__slot"))).drop("near")
    return picked.join(mates, F.col("__mate")["__row"] == F.col("__mate_row")).select(
        "i",
        F.col(key).alias("base_key"),
        F.col("__mate")["base_key"].alias("mate_key"),
        *[F.expr(f"{quoted(f)} + __gap * (__mate_{i} - {quoted(f)})").alias(f) for i, f in enumerate(features)],
        F.lit(small).alias(label),
    )


def smote_rows(
    train: DataFrame,
    label: str,
    key: str,
    features: Sequence[str],
    ratio: float,
    seed: int,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """Synthetic minority rows on segments to one of the k nearest minority rows."""
    small, rows, others = _minority(train, label)
    n = rows_to_add(rows, others, ratio)
    if rows <= k:
        raise ValueError(f"{k} neighbours need at least {k + 1} minority rows, found {rows}")
    pool = _pool(train.where(F.col(label) == small).select(key, *_doubles(features)))
    indexed = dense_index(_with_neighbours(pool, key, features, k), [key], seed, "base_index")
    i = F.col("i")
    slot = (F.floor(unit_draw("mate", seed, i) * k) + 1).cast("int")
    gap = unit_draw("gap", seed, i)
    drawn = _numbers(train, n, rows, seed).join(indexed, "base_index")
    return _between(drawn.withColumns({"__slot": slot, "__gap": gap}), pool, key, features, small, label)


def adasyn_rows(
    train: DataFrame,
    label: str,
    key: str,
    features: Sequence[str],
    ratio: float,
    seed: int,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """Synthetic rows, more of them where a minority row has majority neighbours."""
    small, rows, others = _minority(train, label)
    n = rows_to_add(rows, others, ratio)
    if rows <= k:
        raise ValueError(f"{k} neighbours need at least {k + 1} minority rows, found {rows}")
    plain = train.select(label, key, *_doubles(features))
    pool = _pool(plain.where(F.col(label) == small).drop(label))
    around = nearest_lists(
        pool, plain, key, [features], k, Metric(2.0), carry=[label], skip_self=True
    )
    other = F.size(F.filter("near", lambda x: x[label] != small))
    hard = around.select(F.col(key).alias("__key"), (other / F.lit(k)).alias("share"))
    hard = stage_table(hard, "hardness")
    total = hard.agg(F.sum("share")).first()[0]
    if not total:
        raise ValueError("no minority row has a majority neighbour: nothing to adapt to")
    copies = F.bround(F.col("share") / total * n).cast("bigint")
    wanted = hard.select("__key", copies.alias("copies")).where("copies > 0")
    sources = _with_neighbours(pool, key, features, k).join(wanted, F.col(key) == F.col("__key"))
    drawn = unfold(sources.drop("__key"), "copies", "i")
    slot = (F.floor(unit_draw("mate", seed, F.col(key), F.col("i")) * k) + 1).cast("int")
    gap = unit_draw("gap", seed, F.col(key), F.col("i"))
    return _between(drawn.withColumns({"__slot": slot, "__gap": gap}), pool, key, features, small, label)


def oversample(
    train: DataFrame,
    label: str,
    key: str,
    features: Sequence[str],
    method: str,
    ratio: float,
    seed: int,
) -> DataFrame:
    """Train rows plus new minority rows; the key column becomes text.

    A new row's key is ``+<key of the row it starts from>:<number>``.
    """
    made = new_rows(train, label, key, features, method, ratio, seed)
    kept = [F.col(key).cast("string").alias(key), label, *features]
    return train.select(*kept).unionByName(made)


def new_rows(
    train: DataFrame,
    label: str,
    key: str,
    features: Sequence[str],
    method: str,
    ratio: float,
    seed: int,
) -> DataFrame:
    """Only the new minority rows."""
    makers = {"smote": smote_rows, "random": random_rows, "adasyn": adasyn_rows}
    if method not in makers:
        raise ValueError(
            f"unknown oversample method {method!r}: expected 'smote', 'random' or 'adasyn'"
        )
    made = makers[method](train, label, key, features, ratio, seed)
    name = F.concat(F.lit("+"), F.col("base_key").cast("string"), F.lit(":"), F.col("i"))
    return made.select(name.alias(key), label, *features)
