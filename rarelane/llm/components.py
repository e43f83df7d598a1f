"""Connected components of a large graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rarelane.session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (a, b: long): the smallest node it reaches.

    Large-star and small-star steps in turn; each halves the depth of the trees, so
    the number of rounds grows with the logarithm of the longest chain.  A node of
    many links is summed before the shuffle, and its join side can be split, since
    both sides are read from staged tables.  Loops, repeated links and links in both
    directions are allowed; links with a null end are left out; an empty table gives
    no rows.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = stage_table(_down(links.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    state = _state(links)
    while state[0]:
        links = _small_star(_large_star(links))
        before, state = state, _state(links)
        if before == state:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b"), F.col("b"))).distinct()


def _down(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, once each."""
    return links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("mark")
    ).first()
    return row["n"], row["mark"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = links.union(links.select("b", "a"))
    least = stage_table(
        both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least"
    )
    return stage_table(
        links.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a")
        .select(F.col("far").alias("a"), F.col("least").alias("b")).distinct(),
        "large",
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = stage_table(links.groupBy("a").agg(F.min("b").alias("least")), "least")
    joined = links.join(least, "a")
    return stage_table(
        joined.select(F.explode(F.array(
            F.struct(F.col("a"), F.col("least").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct(),
        "small",
    )
