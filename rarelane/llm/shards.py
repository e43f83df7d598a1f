"""Shards of a table by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets that fit a task's memory, by a seeded
hash of each row's own name; equal rows have names of their own, so no group of rows
weighs on a bucket.  Pass two puts a bucket in the order of the names, shuffles it by
Fisher and Yates with a generator seeded by (seed, bucket), and writes it.  The buckets
one after the other are a random order of the whole table, the same for every run,
partitioning and repeated task; shard s of k holds the places from ceil(s N / k) to
ceil((s + 1) N / k), so the shards' row counts differ by one at most (law ``rows``).

Null or repeated keys are rows like any other, a null text too.  A row that is larger
than a bucket is a bucket's only burden: it is held once.  Fewer rows than shards leave
shards empty; an empty table gives no rows.  Further columns are carried inside the
struct ``row``, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from rarelane.llm.tables import ROW, with_rows
from rarelane.session import stage_table

#: Bytes of a bucket, which a task holds: raise it with the memory of a core.
BUCKET_BYTES = 64 << 20
#: Bytes of shuffled rows handed on at once.
SLICE_BYTES = 4 << 20


def row_bytes(docs: DataFrame) -> Column:
    """Bytes of a row: those of its strings, and eight for anything else."""
    sizes = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType))
        else F.lit(8)
        for f in docs.schema.fields
    ]
    return sum((s.cast("long") for s in sizes), F.lit(8).cast("long"))


def write_shards(
    docs: DataFrame, folder: str, shards: int, seed: int = 42, key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Write ``docs`` as Parquet below ``folder``, a folder ``shard=s`` for each shard.

    A file's rows are in the order of their ``slot`` in the shard.
    """
    if shards < 1:
        raise ValueError(f"{shards} shards")
    rows = with_rows(docs, key)
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(docs)), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(buckets)).cast("int")
    base = bucket_bases(rows.select(bucket.alias("bucket")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = rows.select(bucket.alias("bucket"), F.lit(None).cast("long").alias("base"), F.col(ROW).alias("name"), whole)
    # a bucket's base comes to its task as a row more, without a join
    bases = base.select("bucket", "base", *[F.lit(None).cast(named.schema[c].dataType).alias(c) for c in ("name", "row")])
    scattered = named.unionByName(bases).repartitionById(buckets, F.col("bucket"))
    out = scattered.mapInArrow(
        lambda b: _shuffled(b, seed, shards, total["n"]),
        T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()),
                      T.StructField("row", named.schema["row"].dataType)]),
    )
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def bucket_bases(buckets: DataFrame) -> DataFrame:
    """``bucket, base``: the rows of all buckets before it; a row per bucket, not per row."""
    counts = stage_table(buckets.groupBy("bucket").count(), "buckets")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return stage_table(
        counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "bases"
    )


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n places: numpy's generator shuffles by Fisher and Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.Philox(key=[seed, bucket])).shuffle(order)
    return order


def shard_starts(n: int, shards: int) -> np.ndarray:
    """First place of each shard, and n."""
    return np.array([-(-s * n // shards) for s in range(shards + 1)], np.int64)


def _shuffled(batches: Iterator[pa.RecordBatch], seed: int, shards: int, n: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    base = pc.max(table.column("base")).as_py()
    table = table.filter(pc.is_null(table.column("base")))
    n_own, bucket = table.num_rows, TaskContext.get().partitionId()
    order = pc.sort_indices(table.column("name")).to_numpy()[fisher_yates(n_own, seed, bucket)]
    rows = table.column("row").combine_chunks()
    del table
    place = base + np.arange(n_own)
    starts = shard_starts(n, shards)
    shard = np.searchsorted(starts, place, "right") - 1
    step = max(1, n_own * SLICE_BYTES // max(1, rows.nbytes))
    for at in range(0, n_own, step):
        some = slice(at, at + step)
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[some], pa.int32()), pa.array(place[some] - starts[shard[some]], pa.int64()),
             rows.take(pa.array(order[some]))],
            ["shard", "slot", "row"],
        )


def read_shards(spark: SparkSession, folder: str, kind: T.StructType) -> DataFrame:
    """``shard, slot, row`` of the files below ``folder``; ``kind``: the schema of the written table."""
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("row", kind),
                           T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)
