"""What the operators share: table reads, shared-folder paths, bounded batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rarelane.session import stage_table

#: Characters of text that a task holds as Python objects at once.
BATCH_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (null: empty), whatever other columns are called."""
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )


def mounted(path: str) -> str:
    """Local form of a folder that all executors mount; memory maps need one.

    Raises for a store without a mount (``hdfs://``, ``s3a://``).
    """
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: memory-mapped files need a folder that executors mount")
    return parts.path


def text_batches(
    batches: Iterator[pa.RecordBatch], chars: int = BATCH_CHARS
) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) lists of at most ``chars`` characters, or of one longer text.

    A batch has the columns ``doc_id`` and ``text``.
    """
    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        column = batch.column("text")
        at, size = 0, 0
        sizes = pc.binary_length(column).to_pylist()
        for i, n in enumerate(sizes):
            if i > at and size + n > chars:
                yield keys[at:i], column.slice(at, i - at).to_pylist()
                at, size = i, 0
            size += n
        if at < len(keys):
            yield keys[at:], column.slice(at).to_pylist()


def replace_file(path: str, data) -> None:
    """Write beside ``path`` and rename: a repeated task attempt leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(own, "wb") as out:
        out.write(data)
    os.replace(own, path)


#: Column that names a single row, in the order of the keys.
ROW = "__rarelane_row"
_LEAST = -(2**63)


def with_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``ROW``: the key (long) if no key is null or repeated, else a string.

    The string orders rows as their keys do, null keys first; rows without a key, or
    with a repeated one, are told apart by a digest of the whole row and a copy number.
    Equal rows are counted and unfolded, so one key of very many rows is no task's burden.
    """
    own = F.col(f"`{key}`").cast("long")
    counts = docs.select(own.alias(ROW)).groupBy(ROW).count().where(F.col(ROW).isNull() | (F.col("count") > 1))
    shared = stage_table(counts.select(ROW), "shared_keys")
    if shared.isEmpty():
        return docs.withColumn(ROW, own)
    keyed = docs.withColumn(ROW, own).where(F.col(ROW).isNotNull())
    others = keyed.join(shared, ROW, "left_semi").drop(ROW).unionByName(docs.where(own.isNull()))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    folded = others.select(F.md5(F.to_json(whole)).alias("digest"), whole.alias("whole")).groupBy("digest").agg(
        F.first("whole").alias("whole"), F.count("*").alias("n")
    )
    copies = folded.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).withColumn("copy", F.format_string("%016x", "copy"))
    columns = [F.col(f"whole.`{c}`").alias(c) for c in docs.columns]
    prefix = F.when(own.isNull(), "0").otherwise(
        F.concat(F.lit("1"), F.lpad(F.hex(own.bitwiseXOR(F.lit(_LEAST))), 16, "0"))
    )
    told = copies.select(*columns, F.concat("digest", "copy").alias(ROW)).withColumn(ROW, F.concat(prefix, F.col(ROW)))
    plain = keyed.join(shared, ROW, "left_anti").drop(ROW).withColumn(ROW, prefix)
    return plain.unionByName(told)


def row_key(row):
    """The key in a value of ``ROW``."""
    if isinstance(row, str):
        return None if row[0] == "0" else int(row[1:17], 16) + _LEAST
    return row


def key_column(rows: DataFrame, column: str = ROW) -> Column:
    """The key (long) in a column of values of ``ROW``."""
    if rows.schema[column].dataType.simpleString() != "string":
        return F.col(column)
    digits = F.conv(F.substring(column, 2, 16), 16, -10).cast("long")
    return F.when(~F.col(column).startswith("0"), digits.bitwiseXOR(F.lit(_LEAST)))


def without_key(rows: DataFrame, column: str = ROW) -> Column:
    """Whether a value of ``ROW`` stands for a row without a key."""
    if rows.schema[column].dataType.simpleString() == "string":
        return F.col(column).startswith("0")
    return F.lit(False)


def row_text(rows: DataFrame) -> DataFrame:
    """Only ``ROW``, under the name that ``text_batches`` reads, and the text (null: empty)."""
    return rows.select(
        F.col(ROW).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
