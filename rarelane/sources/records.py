"""Records of CSV files whose quoted fields hold line breaks, read split by split.

A line break lies inside a field when an odd number of quotes stands before it.  One pass
counts each split's quotes; the parities of the splits before it tell whether a split begins
inside a field.  A second pass then cuts every split into records on its own.  What a split
begins with, when it begins inside a field, belongs to the record that an earlier split left
open: only those few pieces are brought together.

Quotes stand around whole fields only, and one inside a field is doubled.  Lines end in a line
feed, after a carriage return or not.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rarelane.session import stage_table

_PIECES = "file string, block long, place long, kind string, record string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in file order within a split, with the file and the split they begin in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _inside(lines: DataFrame) -> dict[str, np.ndarray]:
    """Per file the splits that begin inside a field: eight bytes per split at most leave the cluster."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    odd = stage_table(lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")), "quotes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_ones = odd.withColumn("before", F.sum("odd").over(before)).where("before % 2 = 1")
    found = open_ones.groupBy("file").agg(F.sort_array(F.collect_list("block")).alias("blocks")).collect()
    return {r["file"]: np.array(r["blocks"], np.int64) for r in found}


class _Split:
    """Cuts the lines of one split into records."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.tail = inside  # what comes first still belongs to an earlier split's record
        self.held: list[str] = []
        self.place = 0

    def add(self, values: pa.Array) -> Iterator[tuple]:
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2
        lines = values.to_pylist()
        at = 0
        for end in (np.flatnonzero(after == 0) + 1).tolist():
            self.held += lines[at:end]
            at = end
            yield self._row("tail" if self.tail else "whole")
        self.held += lines[at:]
        self.inside = bool(after[-1]) if len(after) else self.inside

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield self._row("tail" if self.tail else "open")

    def _row(self, kind: str) -> tuple:
        row = (self.file, self.block, self.place, kind, "\n".join(self.held))
        self.held, self.tail = [], False
        self.place += kind != "tail"
        return row


def _pieces(lines: DataFrame) -> DataFrame:
    """``file, block, place, kind, record``; kind: whole, open (goes on in the next split), or tail."""
    inside = lines.sparkSession.sparkContext.broadcast(_inside(lines))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            rows: list[tuple] = []
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
            change = [i for i in range(batch.num_rows) if not i or blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
            for begin, end in zip(change, [*change[1:], batch.num_rows]):
                file, block = files[begin], int(blocks[begin])
                if split is None or (split.file, split.block) != (file, block):
                    if split is not None:
                        rows += split.close()
                    known = inside.value.get(file, np.empty(0, np.int64))
                    split = _Split(file, block, bool(np.isin(block, known)))
                rows += split.add(batch.column("value").slice(begin, end - begin))
            yield batch_of(rows)
        if split is not None:
            yield batch_of(list(split.close()))

    return lines.mapInArrow(cut, _PIECES)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, place, record``: all records but blank ones; the first of a file has block 0 and place 0."""
    pieces = stage_table(_pieces(_lines(spark, path)), "records")
    parts = pieces.where("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))  # a split's tail comes before what it leaves open
    lot = F.sum((F.col("kind") == "open").cast("int")).over(order)
    joined = parts.withColumn("lot", lot).groupBy("file", "lot").agg(
        F.min("block").alias("block"), F.min_by("place", "block").alias("place"),
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"),
    )
    whole = pieces.where("kind = 'whole'").select("file", "block", "place", "record")
    made = joined.select("file", "block", "place", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    every = whole.unionByName(made).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return every.where(F.trim("record") != "")


def split_header(records: DataFrame) -> tuple[list[str], DataFrame]:
    """Column names, which all files must share, and the records without the headers."""
    first = (F.col("block") == 0) & (F.col("place") == 0)
    found = [r["record"] for r in records.where(first).select("record").distinct().limit(2).collect()]
    if not found:
        return [], records.select("record")
    if len(found) > 1:
        raise ValueError(f"files have different headers: {found[0]!r} and {found[1]!r}")
    return next(csv.reader([found[0]])), records.where(~first).select("record")
