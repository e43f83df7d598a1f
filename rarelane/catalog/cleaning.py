"""Sources, cleaning, row aggregates and target encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarelane.catalog.registry import (
    EVENTS, ORDERS, events, orders, query, r6, table,
)
from rarelane.functions import labels
from rarelane.functions.labels import encode_label, to_binary, to_signed
from rarelane.functions.rowwise import ROW_AGGREGATES, add_row_aggregates
from rarelane.operators import clean, encode
from rarelane.plans.prepare import add_row_id
from rarelane.session import staging_path
from rarelane.sources.tables import concat_tables, read_csv


@query("csv_scan", """
SELECT o_orderkey, o_orderstatus,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS o_totalprice,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority ELSE ' NULL' END AS o_orderpriority,
       o_orderstatus = 'F' AS is_final,
       'a "' || o_orderstatus || '", b' AS quoted,
       CAST(o_orderkey % 3 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'f' END AS code
FROM orders""")
def csv_scan(spark, folder):
    """Orders written as CSV, read back with types found.

    ``NA`` is a missing value, `` NULL`` behind a blank is a text; quotes inside quotes
    are doubled; codes such as ``1d`` are no numbers.
    """
    missing = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    text = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(missing, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(missing, " NULL").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_orderstatus") == "F").alias("is_final"),
        F.expr("""concat('a "', o_orderstatus, '", b')""").alias("quoted"),
        F.expr("concat(cast(o_orderkey % 3 as string), if(o_orderkey % 2 = 0, 'd', 'f'))").alias("code"),
    )
    path = staging_path(spark, "csv")
    text.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    return read_csv(spark, path)


@query("csv_line_breaks", """
SELECT o_orderkey, 'first line' || chr(10) || o_orderpriority AS note FROM orders""")
def csv_line_breaks(spark, folder):
    """Fields in quotes that hold line breaks."""
    text = table(spark, folder, "orders").select(
        "o_orderkey", F.expr("concat('first line', chr(10), o_orderpriority)").alias("note")
    )
    path = staging_path(spark, "csv")
    text.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, line_breaks=True)


@query("union_duplicate_ids", """
WITH t AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, count(*) AS n,
       count(*) AS keys
FROM (SELECT * FROM t UNION ALL SELECT * FROM t UNION ALL SELECT NULL, o_orderstatus FROM t WHERE o_orderkey % 5 = 0)
GROUP BY 1, 2""")
def union_duplicate_ids(spark, folder):
    """Two inputs counted alike, and rows without an index: every row keeps a key of its own."""
    src = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    bare = src.where("o_orderkey % 5 = 0").select(F.lit(None).cast("bigint").alias("o_orderkey"), "o_orderstatus")
    keyed = add_row_id(concat_tables([src, src, bare]), "o_orderkey")
    return keyed.groupBy(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus").agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("keys")
    )


@query("union_inputs", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus <> 'F'""")
def union_inputs(spark, folder):
    """Two inputs, the second one without the priority column."""
    src = table(spark, folder, "orders")
    first = src.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority")
    second = src.where("o_orderstatus <> 'F'").select("o_totalprice", "o_orderkey")
    return concat_tables([first, second])


_LABEL_TEXT = """CASE event_type WHEN 'error' THEN ' Yes' WHEN 'click' THEN 'f'
  WHEN 'view' THEN 'NO ' WHEN 'purchase' THEN '0' ELSE 'N' END"""


@query("label_binary", """
SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label,
       CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS signed,
       CAST(event_type = 'error' AS INTEGER) AS back
FROM events""")
def label_binary(spark, folder):
    """Yes/no words to 0/1, then to -1/+1 and back."""
    text = table(spark, folder, "events").select("event_id", F.expr(_LABEL_TEXT).alias("label"))
    coded = encode_label(text, "label").withColumn("signed", to_signed(F.col("label")))
    return coded.withColumn("back", to_binary(F.col("signed")))


@query("null_drop", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""")
def null_drop(spark, folder):
    src = table(spark, folder, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("o_orderpriority")
    )
    return clean.drop_null_rows(src)


@query("dedup", """
SELECT DISTINCT * FROM lineitem""")
def dedup(spark, folder):
    """All columns; a part of the rows is given twice."""
    rows = table(spark, folder, "lineitem")
    return clean.drop_duplicate_rows(rows.unionByName(rows.where("l_orderkey % 3 = 0")))


@query("log1p_amount", """
SELECT o_orderkey, round(ln(1 + greatest(o_totalprice - 200000, 0)), 6) + 0.0 AS amount
FROM orders""")
def log1p_amount(spark, folder):
    """Amounts below zero count as zero."""
    src = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") - 200000).alias("amount")
    )
    return clean.log_amount(src, "amount").withColumn("amount", r6("amount"))


@query("row_aggregates", """
WITH v AS (
  SELECT l_orderkey, l_linenumber, l_quantity - 25 AS a, l_extendedprice / 977 AS b,
         l_discount * 100 - 5 AS c, l_tax * 100 AS d
  FROM lineitem),
m AS (SELECT *, (a + b + c + d) / 4 AS mean FROM v),
s AS (SELECT *, ((a-mean)*(a-mean) + (b-mean)*(b-mean) + (c-mean)*(c-mean) + (d-mean)*(d-mean))
             / 4 AS var FROM m)
SELECT l_orderkey, l_linenumber,
       round(a + b + c + d, 6) + 0.0 AS "Comp_Sum",
       round(least(a, b, c, d), 6) + 0.0 AS "Comp_Min",
       round(greatest(a, b, c, d), 6) + 0.0 AS "Comp_Max",
       round(mean, 6) + 0.0 AS "Comp_Avg",
       round(sqrt(var), 6) + 0.0 AS "Comp_Std",
       CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) + CAST(c > 0 AS INTEGER)
         + CAST(d > 0 AS INTEGER) AS "Comp_Pos",
       CAST(a < 0 AS INTEGER) + CAST(b < 0 AS INTEGER) + CAST(c < 0 AS INTEGER)
         + CAST(d < 0 AS INTEGER) AS "Comp_Neg",
       round(var, 6) + 0.0 AS "Comp_Var"
FROM s""")
def row_aggregates(spark, folder):
    """The eight aggregates over four V columns."""
    src = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") - 25).alias("Va"), (F.col("l_extendedprice") / 977).alias("Vb"),
        (F.col("l_discount") * 100 - 5).alias("Vc"), (F.col("l_tax") * 100).alias("Vd"),
    )
    made = add_row_aggregates(src, clean.v_columns(src, "none"))
    whole = ("Comp_Pos", "Comp_Neg")
    return made.select(
        "l_orderkey", "l_linenumber",
        *[F.col(c) if c in whole else r6(c).alias(c) for c in ROW_AGGREGATES],
    )


@query("feature_names", """
SELECT event_id, round(value, 6) AS "V_value", round(k, 6) AS "V_k", y, "at" FROM (
  SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y, value,
         CAST(props->>'$.k' AS DOUBLE) AS k, CAST(epoch_us(ts) AS DOUBLE) AS at FROM events)""")
def feature_names(spark, folder):
    """Prefix rename, feature discovery and projection."""
    src = events(spark, folder).select("event_id", "y", "value", "k", "at")
    ignored = ["event_id", "at"]
    named = clean.prefix_features(src, "y", ignored)
    features = clean.v_columns(named, "y", ignored)
    return clean.project_features(named, [*features, "at"], ["event_id", "y"])


def _encode_sql(src: str, cat: str, n: str = "") -> str:
    """CTEs: table ``enc<n>`` with category ``c`` and its encoded value ``e``."""
    return f"""
prior{n} AS (SELECT avg(y) AS g FROM {src}),
stats{n} AS (SELECT {cat} AS c, count(y) AS n, sum(y) AS p FROM {src}
          WHERE {cat} IS NOT NULL GROUP BY 1),
smooth{n} AS (SELECT c, (p + 10 * g) / (n + 10) AS s FROM stats{n}, prior{n}),
span{n} AS (SELECT min(s) AS lo, max(s) AS hi FROM smooth{n}),
enc{n} AS (SELECT c, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE s END AS e
          FROM smooth{n}, span{n})"""


@query("target_encode", f"""
WITH {EVENTS}, {_encode_sql("ev", "user_name")}
SELECT event_id, round(e, 6) + 0.0 AS user_name FROM ev LEFT JOIN enc ON user_name = c""")
def target_encode(spark, folder):
    src = events(spark, folder).select("event_id", "y", "user_name")
    mapping = encode.fit_target_encoding(src, ["user_name"], "y")
    coded = encode.apply_target_encoding(src, mapping, ["user_name"])
    return coded.select("event_id", r6("user_name").alias("user_name"))


@query("target_encode_shuffled", f"""
WITH {ORDERS}, nulled AS (
  SELECT o_orderkey, y, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, customer
  FROM od),
{_encode_sql("nulled", "customer")},
{_encode_sql("nulled", "o_orderpriority", "2")}
SELECT o_orderkey, round(enc.e, 6) + 0.0 AS customer, round(enc2.e, 6) + 0.0 AS o_orderpriority
FROM nulled LEFT JOIN enc ON customer = enc.c LEFT JOIN enc2 ON o_orderpriority = enc2.c""")
def target_encode_shuffled(spark, folder):
    """Two columns in one pass; maps treated as too large to broadcast.

    Frequent categories are broadcast, rare ones shuffled; a NULL stays NULL.
    """
    src = orders(spark, folder).select(
        "o_orderkey", "y",
        F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("o_orderpriority"), "customer",
    )
    columns = ["customer", "o_orderpriority"]
    mapping = encode.fit_target_encoding(src, columns, "y")
    coded = encode.apply_target_encoding(src, mapping, columns, broadcast_bytes=0)
    return coded.select("o_orderkey", *[r6(c).alias(c) for c in columns])


@query("label_problems", """
SELECT CAST(label AS VARCHAR) AS value, count(*) AS n FROM embeddings WHERE label IS NULL OR label NOT IN (0, 1) GROUP BY 1""")
def label_problems(spark, folder):
    """Labels that are neither 0 nor 1, and how many rows hold each."""
    return labels.label_problems(table(spark, folder, "embeddings"), "label", (0, 1))
