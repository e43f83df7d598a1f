"""Exact-size samples and splits without a global sort.

Rows are ordered by an md5 digest of their key.  Taking the first n rows of a
class then means finding one cut digest: count rows per digest prefix (at most
4,096 groups per class), pick the prefix where the running count passes n, and
refine only inside that prefix.  The sample itself is a plain filter on the
digest, so it runs wherever the rows are and moves nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rarelane.functions.draws import order_hash

PREFIX_DIGITS = 3
SMALL_GROUP = 4096
# A histogram is read to the driver: labels times 4,096 prefixes, checked.
MAX_HISTOGRAM = 500_000
DIGEST_DIGITS = 32


@dataclass(frozen=True)
class Cut:
    """Take digests below ``digest`` and ``ties`` of the ``tied`` rows equal to it."""

    digest: str | None
    ties: int = 0
    tied: int = 0


@dataclass(frozen=True)
class HashOrder:
    """Rows of ``df`` with their digest column, and the digest histogram."""

    df: DataFrame
    group: str
    counts: dict[object, int]
    histogram: dict[object, dict[str, int]]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def hash_order(df: DataFrame, group: str, stage: str, seed: int, key: Sequence[str]) -> HashOrder:
    """Digest every row and count rows per (group, digest prefix): one job.

    The histogram has at most 4,096 rows per label, whatever the table's size.
    """
    hashed = df.withColumn("__h", order_hash(stage, seed, key))
    prefix = F.substring("__h", 1, PREFIX_DIGITS).alias("p")
    counted = (
        hashed.groupBy(F.col(group).alias("g"), prefix).count()
        .limit(MAX_HISTOGRAM + 1).collect()
    )
    if len(counted) > MAX_HISTOGRAM:
        raise ValueError(f"{group!r} holds too many different values to be a label")
    histogram: dict[object, dict[str, int]] = {}
    for r in counted:
        histogram.setdefault(r["g"], {})[r["p"]] = r["count"]
    counts = {g: sum(h.values()) for g, h in histogram.items()}
    return HashOrder(hashed, group, counts, histogram)


def _group_is(group: str, value: object) -> Column:
    return F.col(group).eqNullSafe(F.lit(value))


def find_cuts(order: HashOrder, take: Mapping[object, int]) -> dict[object, Cut]:
    """The cut digest for each group so that exactly ``take[group]`` rows pass."""
    cuts: dict[object, Cut] = {}
    open_groups: dict[object, tuple[str, int, int]] = {}
    for g, n in take.items():
        total = order.counts.get(g, 0)
        if n <= 0:
            cuts[g] = Cut("")
        elif n >= total:
            cuts[g] = Cut(None)
        else:
            open_groups[g] = _boundary("", n, order.histogram[g])
    while open_groups:
        wide = {
            g: s
            for g, s in open_groups.items()
            if s[2] > SMALL_GROUP and len(s[0]) + PREFIX_DIGITS <= DIGEST_DIGITS
        }
        # Narrow groups read their few digests, wide ones the next digits.
        ready = {g: s for g, s in open_groups.items() if g not in wide}
        if ready:
            for g, digests in _count_digits(order, ready, DIGEST_DIGITS).items():
                prefix, left, _ = ready[g]
                digest, left, tied = _boundary("", left, digests)
                cuts[g] = Cut(digest, left, tied)
        open_groups = {
            g: _boundary(wide[g][0], wide[g][1], digits)
            for g, digits in _count_digits(order, wide, PREFIX_DIGITS).items()
        } if wide else {}
    return cuts


def _boundary(prefix: str, left: int, counts: Mapping[str, int]) -> tuple[str, int, int]:
    """Extended prefix where the running count reaches ``left``, what is left, its size."""
    for digits in sorted(counts):
        if left <= counts[digits]:
            return prefix + digits, left, counts[digits]
        left -= counts[digits]
    raise AssertionError("cut lies beyond the counted rows")


def _count_digits(
    order: HashOrder, states: Mapping[object, tuple[str, int, int]], digits: int
) -> dict[object, dict[str, int]]:
    """Row counts per next digits (or per whole digest) inside each open prefix."""
    inside = [
        _group_is(order.group, g) & F.col("__h").startswith(prefix)
        for g, (prefix, _, _) in states.items()
    ]
    start = [
        F.when(_group_is(order.group, g), F.lit(len(prefix) + 1))
        for g, (prefix, _, _) in states.items()
    ]
    part = F.col("__h") if digits >= DIGEST_DIGITS else F.substring(
        F.col("__h"), F.coalesce(*start), F.lit(digits)
    )
    found: dict[object, dict[str, int]] = {g: {} for g in states}
    for r in (
        order.df.where(reduce(or_, inside))
        .groupBy(F.col(order.group).alias("g"), part.alias("p"))
        .count()
        .collect()
    ):
        found[r["g"]][r["p"]] = r["count"]
    return found


def passes(order: HashOrder, cuts: Mapping[object, Cut]) -> Column:
    """Row filter for the cuts; tied rows at a cut pass only when all of them do."""
    tests = []
    for g, cut in cuts.items():
        mine = _group_is(order.group, g)
        if cut.digest is None:
            tests.append(mine)
        elif cut.digest:
            whole = cut.ties == cut.tied
            below = F.col("__h") <= cut.digest if whole else F.col("__h") < cut.digest
            tests.append(mine & below)
    return reduce(or_, tests) if tests else F.lit(False)


def mark_taken(order: HashOrder, take: Mapping[object, int], into: str) -> DataFrame:
    """Add boolean column ``into``: true for exactly ``take[group]`` rows per group."""
    cuts = find_cuts(order, take)
    marked = order.df.withColumn(into, F.coalesce(passes(order, cuts), F.lit(False)))
    split = {g: c for g, c in cuts.items() if c.digest and c.ties < c.tied}
    if split:
        marked = _split_identical_rows(order, marked, split, into)
    return marked.drop("__h")


def _split_identical_rows(
    order: HashOrder, marked: DataFrame, split: Mapping[object, Cut], into: str
) -> DataFrame:
    """Cut through rows that share one digest.

    Only possible when they share the whole key.  Such rows must be equal in all
    columns, so they are interchangeable: count them, then unfold the count.
    """
    at_cut = reduce(
        or_, [_group_is(order.group, g) & (F.col("__h") == c.digest) for g, c in split.items()]
    )
    columns = [c for c in marked.columns if c != into]
    packed = marked.where(at_cut).groupBy(*columns).count()
    if packed.count() > len(split):
        raise ValueError("the key columns do not identify rows: rows with one key differ")
    allowed = F.coalesce(
        *[F.when(_group_is(order.group, g), F.lit(c.ties)) for g, c in split.items()]
    )
    unfolded = unfold(packed, "count", "__i").withColumn(into, F.col("__i") < allowed)
    return marked.where(~F.coalesce(at_cut, F.lit(False))).unionByName(
        unfolded.select(*marked.columns)
    )


UNFOLD_CHUNK = 100_000


def unfold(df: DataFrame, times: str, ordinal: str) -> DataFrame:
    """Repeat each row ``times`` times with ``ordinal`` 0, 1, ...; drops ``times``.

    Two steps, so that one row with a huge count is spread over many tasks.
    """
    n = F.col(times)
    chunks = (
        df.where(n > 0)
        .withColumn("__c", F.explode(F.sequence(F.lit(0), F.ceil(n / UNFOLD_CHUNK).cast("int") - 1)))
    )
    if chunks.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        chunks = chunks.hint("rebalance")
    low = F.col("__c").cast("bigint") * UNFOLD_CHUNK
    high = F.least(low + UNFOLD_CHUNK, n.cast("bigint")) - 1
    return chunks.withColumn(ordinal, F.explode(F.sequence(low, high))).drop("__c", times)


def resolve_class_targets(
    positives: int,
    negatives: int,
    max_positives: int | None = None,
    max_negatives: int | None = None,
    ratio: float | None = None,
) -> tuple[int, int]:
    """How many positive and negative rows to keep."""
    keep = positives if max_positives is None else min(max_positives, positives)
    if ratio is not None:
        other = round(ratio * keep)
    elif max_negatives is not None:
        other = max_negatives
    else:
        other = keep
    return keep, min(other, negatives)


def largest_remainder(counts: Mapping[object, int], total: int) -> dict[object, int]:
    """Share ``total`` rows over the classes in proportion to their counts.

    Whole shares first; the rows left over go to the largest fractions, the
    lower label first among equal ones.
    """
    rows = sum(counts.values())
    share = {g: divmod(total * n, rows) for g, n in counts.items()}
    got = {g: whole for g, (whole, _) in share.items()}
    rest = total - sum(got.values())
    for g in sorted(counts, key=lambda g: (-share[g][1], g))[:rest]:
        got[g] += 1
    return got


def balance_classes(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    seed: int,
    max_positives: int | None = None,
    max_negatives: int | None = None,
    ratio: float | None = None,
) -> DataFrame:
    """Exact-size sample per class; rows with any other label are left out."""
    order = hash_order(df, label, "sample", seed, key)
    pos, neg = resolve_class_targets(
        order.counts.get(1, 0), order.counts.get(0, 0), max_positives, max_negatives, ratio
    )
    marked = mark_taken(order, {1: pos, 0: neg}, "__keep")
    return marked.where("__keep").drop("__keep")


def cap_total(
    df: DataFrame, label: str, key: Sequence[str], seed: int, limit: int | None
) -> DataFrame:
    """Stratified trim to ``limit`` rows, only when there are more."""
    if limit is None:
        return df
    order = hash_order(df, label, "cap", seed, key)
    if sum(order.counts.values()) <= limit:
        return df
    marked = mark_taken(order, largest_remainder(order.counts, limit), "__keep")
    return marked.where("__keep").drop("__keep")


def split_random(
    df: DataFrame, label: str, key: Sequence[str], seed: int, test_size: float, into: str = "fold"
) -> DataFrame:
    """Stratified random split: adds ``fold`` = ``train`` or ``test``.

    ceil(n * test_size) rows are test; train counts per class follow by largest
    remainder.
    """
    order = hash_order(df, label, "split", seed, key)
    rows = sum(order.counts.values())
    train = largest_remainder(order.counts, rows - math.ceil(rows * test_size))
    return _name_folds(mark_taken(order, train, "__train"), into)


def _name_folds(df: DataFrame, into: str) -> DataFrame:
    fold = F.when(F.col("__train"), F.lit("train")).otherwise(F.lit("test"))
    return df.withColumn(into, fold).drop("__train")


TIME_BINS = 4096


def _as_number(df: DataFrame, time: str) -> Column:
    """Time column as a double; timestamps count microseconds, dates days."""
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("double")
    return F.col(time).cast("double")


def split_chronological(
    df: DataFrame, time: str, key: Sequence[str], seed: int, test_size: float, into: str = "fold"
) -> DataFrame:
    """Earliest rows are train, the latest round(n * test_size) are test.

    Rows without a time come last.  Rows with equal time at the cut are ordered
    by key digest.
    """
    t = _as_number(df, time)
    ends = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(t).alias("timed"),
        F.min(t).alias("lo"), F.max(t).alias("hi"),
    ).first()
    train = ends["n"] - round(ends["n"] * test_size)
    if train >= ends["timed"]:
        before, at_cut, left = t.isNotNull(), t.isNull(), train - ends["timed"]
    else:
        instant, left = _time_cut(df, t, ends["lo"], ends["hi"], train)
        before, at_cut = t < instant, t == instant
    place = F.when(at_cut, 1).when(before, 0).otherwise(2)
    order = hash_order_at(df, place, key, seed)
    marked = mark_taken(order, {0: order.counts.get(0, 0), 1: left}, "__train")
    return _name_folds(marked.drop("__place"), into)


def hash_order_at(df: DataFrame, place: Column, key: Sequence[str], seed: int) -> HashOrder:
    """Digest order with only the rows at the cut (place 1) counted by prefix."""
    placed = df.withColumn("__place", place)
    hashed = placed.withColumn("__h", order_hash("split", seed, key))
    prefix = F.when(F.col("__place") == 1, F.substring("__h", 1, PREFIX_DIGITS)).otherwise("")
    histogram: dict[object, dict[str, int]] = {}
    for r in hashed.groupBy(F.col("__place").alias("g"), prefix.alias("p")).count().collect():
        histogram.setdefault(r["g"], {})[r["p"]] = r["count"]
    counts = {g: sum(h.values()) for g, h in histogram.items()}
    return HashOrder(hashed, "__place", counts, histogram)


def _time_cut(df: DataFrame, t: Column, lo: float, hi: float, left: int) -> tuple[float, int]:
    """Time of the ``left``-th earliest row, and how many rows of that time to take.

    Counts rows in 4,096 equal bins, zooms into the bin holding the cut, and
    stops when that bin holds few distinct times.
    """
    while True:
        width = (hi - lo) / TIME_BINS
        zoomed = df.where((t >= lo) & (t <= hi))
        if not width > 0 or lo + width == lo:
            exact = zoomed.groupBy(t.alias("t"))
        else:
            slot = F.least(F.floor((t - lo) / width), F.lit(TIME_BINS - 1))
            bins = (
                zoomed.groupBy(slot.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
                .orderBy("b")
                .collect()
            )
            for b in bins:
                if left <= b["n"]:
                    break
                left -= b["n"]
            lo, hi = b["lo"], b["hi"]
            if lo == hi:
                return lo, left
            if b["n"] > SMALL_GROUP:
                continue
            exact = df.where((t >= lo) & (t <= hi)).groupBy(t.alias("t"))
        for r in exact.count().orderBy("t").collect():
            if left <= r["count"]:
                return r["t"], left
            left -= r["count"]
        raise AssertionError("cut lies beyond the counted rows")
