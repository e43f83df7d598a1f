"""Raw inputs: CSV or Parquet, one or two files, with missing values as NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rarelane.functions.text import quoted
from rarelane.operators.clean import nan_to_null
from rarelane.session import stage_table
from rarelane.sources.records import csv_records, split_header

# Texts that mean a missing value in a CSV field.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts read as booleans when a whole column holds nothing else.
BOOLEAN_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]


# Texts of a whole number and of any number; other words that a cast would accept stay text.
WHOLE_NUMBER = r"^\\s*[+-]?[0-9]{1,19}\\s*$"
NUMBER = (
    r"^\\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i)inf(inity)?)\\s*$"
)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
    line_breaks: bool = False,
) -> DataFrame:
    """CSV with a header; a quote inside quotes is doubled.

    ``line_breaks``: fields in quotes may hold line breaks.  Files are split all the
    same, at the price of a pass that counts quotes; leave it off for files without them.

    With a schema the file is read as declared.  Without one every field is read
    as text, missing-value texts become NULL, and one aggregate decides per
    column: bigint if every value is whole, double if every value is a number,
    boolean, else text.  (Deciding before the missing texts are gone would turn
    a number column with one ``NA`` into text.)
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
    if line_breaks:
        names, records = split_header(csv_records(spark, path))
        if schema is not None:
            kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            if names and names != kind.names:
                raise ValueError(f"the header {names} does not name the columns {kind.names}")
            return nan_to_null(_parsed(records, kind, {"nullValue": ""}))
        raw = _parsed(records, T.StructType([T.StructField(n, T.StringType()) for n in names]), {"emptyValue": ""})
    elif schema is not None:
        return nan_to_null(reader.schema(schema).option("nullValue", "").csv(path))
    else:
        raw = reader.option("inferSchema", False).option("emptyValue", "").csv(path)
    missing = ", ".join(f"'{t}'" for t in MISSING_TEXTS)
    text = raw.selectExpr(*[
        f"CASE WHEN {quoted(c)} NOT IN ({missing}) THEN {quoted(c)} END AS {quoted(c)}"
        for c in raw.columns
    ])
    kinds = _column_kinds(text)
    return text.selectExpr(*[
        f"cast(trim({quoted(c)}) as {kinds[c]}) AS {quoted(c)}"
        if kinds[c] != "string" else quoted(c)
        for c in text.columns
    ])


def _parsed(records: DataFrame, kind: T.StructType, options: dict[str, str]) -> DataFrame:
    """Fields of whole records, which may hold line breaks."""
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kind.fields)
    every = records.select(F.from_csv("record", fields, {"escape": '"', "multiLine": "true", **options}).alias("r"))
    return every.select(*[F.col(f"r.{quoted(n)}").alias(n) for n in kind.names])


def _column_kinds(text: DataFrame) -> dict[str, str]:
    tests, boolean = [], ", ".join(f"'{t}'" for t in BOOLEAN_TEXTS)
    for i, name in enumerate(text.columns):
        v = quoted(name)
        tests += [
            f"count({v}) AS n{i}",
            f"count_if({v} RLIKE '{WHOLE_NUMBER}' AND try_cast(trim({v}) AS bigint) IS NOT NULL) AS w{i}",
            f"count_if({v} RLIKE '{NUMBER}') AS d{i}",
            f"count_if({v} IN ({boolean})) AS b{i}",
        ]
    seen = text.selectExpr(*tests).first()
    kinds = {}
    for i, name in enumerate(text.columns):
        n = seen[f"n{i}"]
        if n == 0 or seen[f"d{i}"] == n and seen[f"w{i}"] < n:
            kinds[name] = "double"
        elif seen[f"w{i}"] == n:
            kinds[name] = "bigint"
        elif seen[f"b{i}"] == n:
            kinds[name] = "boolean"
        else:
            kinds[name] = "string"
    return kinds


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by the ending of the path or of the files in it, CSV otherwise.

    CSV is parsed once and staged: the several passes of a preparation then read
    typed columns instead of parsing text again.
    """
    if path.rstrip("/").endswith(".parquet") or _holds_parquet(spark, path):
        return nan_to_null(spark.read.parquet(path))
    return stage_table(read_csv(spark, path), "input")


def _holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds Parquet files; only names are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return not files.option("pathGlobFilter", "*.parquet").load(path).select("path").isEmpty()


def concat_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column one table lacks is NULL there."""
    if not tables:
        raise ValueError("give at least one input table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_inputs(spark: SparkSession, train_file: str | None, test_file: str | None) -> DataFrame:
    """The train and the test file in one table (it is split again later)."""
    paths = [str(p) for p in (train_file, test_file) if p is not None]
    if not paths:
        raise ValueError("give train_file, test_file or both")
    return concat_tables([read_table(spark, p) for p in paths])
