"""Registration of queries, shared inputs and shared SQL parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Errors among events: key, label ``y``, one category and three numbers."""
    return table(spark, folder, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.col("user_id").cast("string").alias("user_name"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("user_id").cast("double").alias("u"),
        micros("ts").alias("at"),
    )


EVENTS = """ev AS (
  SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y,
         CAST(user_id AS VARCHAR) AS user_name, value,
         CAST(props->>'$.k' AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS u,
         CAST(epoch_us(ts) AS DOUBLE) AS at
  FROM events)"""


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as 64 columns ``V0 .. V63`` and the label ``y`` = class 1."""
    wide = [f"cast(embedding[{i}] as double) AS V{i}" for i in range(64)]
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id", "cast(label = 1 as int) AS y", *wide
    )


VECTORS = [f"V{i}" for i in range(64)]


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        "o_totalprice", "o_orderdate", "o_orderpriority",
        F.col("o_custkey").cast("string").alias("customer"),
    )


ORDERS = """od AS (
  SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice, o_orderdate,
         o_orderpriority, CAST(o_custkey AS VARCHAR) AS customer
  FROM orders)"""


def share_sql(out: str, src: str, label: str, total: str) -> str:
    """CTEs: ``total`` rows shared over the labels of ``src`` by largest remainder.

    ``total`` is an expression over ``rows_all``; the result has ``g, take``.
    """
    return f"""
{out}_n AS (SELECT {label} AS g, count(*) AS n FROM {src} GROUP BY 1),
{out}_w AS (SELECT g, n, sum(n) OVER () AS rows_all FROM {out}_n),
{out}_t AS (SELECT g, n, CAST(rows_all AS BIGINT) AS rows_all,
            CAST({total} AS BIGINT) AS wanted FROM {out}_w),
{out}_s AS (SELECT g, wanted, (wanted * n) // rows_all AS whole,
            (wanted * n) % rows_all AS rest FROM {out}_t),
{out} AS (SELECT g, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, g)
          <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS take FROM {out}_s)"""


def split_sql(out: str, src: str, key: str, label: str = "y", seed: int = 42) -> str:
    """CTEs: ``src`` with ``fold``, a stratified 70/30 split in digest order."""
    train = "rows_all - ceil(rows_all * CAST(0.3 AS DOUBLE))"
    return share_sql(f"{out}_share", src, label, train) + f""",
{out} AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.{label}
          ORDER BY md5('split|{seed}|' || CAST(s.{key} AS VARCHAR))) <= a.take
          THEN 'train' ELSE 'test' END AS fold
          FROM {src} s JOIN {out}_share a ON a.g = s.{label})"""
