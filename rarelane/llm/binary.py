"""Token ids as flat binary files with 64-bit document offsets, read by memory map.

Layout of a folder, one triple per part, parts in ascending key order:

* ``part-00000.ids``: token ids, unsigned 16-bit when the vocabulary fits, else 32-bit, little-endian
* ``part-00000.docs``: document keys, signed 64-bit; the smallest long stands for a null key
* ``part-00000.offsets``: n + 1 unsigned 64-bit positions over *all* parts

A part's first position is the prefix sum of the token counts of the parts
before it.  Files are renamed into place, so repeated task attempts are safe.

Null text: empty, which leaves the end id alone.  Null keys come first.  Repeated
keys are kept, each row as a document, ordered by text.  An empty table gives a
folder without parts and no rows.  Other columns are not read.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rarelane.llm.tables import keyed_text, mounted, replace_file, text_batches
from rarelane.llm.tokens import encoder

NULL_KEY = -(2**63)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, spaces: bool, end_id: int) -> int:
    """Encode ``docs`` into ``folder`` and return the number of parts.

    One shuffle orders the texts by key; ids are made where the ordered rows lie.
    """
    spark = docs.sparkSession
    root = mounted(folder)
    os.makedirs(root, exist_ok=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(vocabulary, spaces)
        kind = "<u2" if max(coder.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        end = np.asarray([end_id], "<u4").tobytes()
        path = f"{root}/part-{part:05d}"
        own = f"{path}.ids.{os.getpid()}.{os.urandom(4).hex()}"
        keys, counts = [], []
        out = None
        for ids, texts in text_batches(batches):
            out = out or open(own, "wb")
            encoded = coder.encode(texts)
            keys.append(np.asarray([NULL_KEY if k is None else k for k in ids], "<i8"))
            counts.append(np.asarray([len(e) // 4 + 1 for e in encoded], "<u8"))
            data = end.join([*encoded, b""])
            out.write(np.frombuffer(data, "<u4").astype(kind).tobytes())
        if out is None:
            return
        out.close()
        os.replace(own, f"{path}.ids")
        replace_file(f"{path}.docs", np.concatenate(keys).tobytes())
        counted = np.concatenate(counts)
        replace_file(f"{path}.counts", counted.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "width": pa.array([int(kind[-1])], pa.int32()),
            "n_tokens": pa.array([int(counted.sum())], pa.int64()),
        })

    ordered = keyed_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = ordered.mapInArrow(encode, "part int, width int, n_tokens long")
    listed = f"{folder.rstrip('/')}/parts.parquet"
    parts.write.mode("overwrite").parquet(listed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/part-{row['part']:05d}"
                counts = np.fromfile(f"{path}.counts", "<u8")
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8") + np.uint64(row["base"])
                replace_file(f"{path}.offsets", offsets.astype("<u8").tobytes())
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32())})

    based = _with_base(spark.read.schema("part int, width int, n_tokens long").parquet(listed))
    return based.repartition("part").mapInArrow(place, "part int").count()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in any order."""
    root = mounted(folder)
    parts = spark.read.schema("part int, width int, n_tokens long").parquet(f"{folder.rstrip('/')}/parts.parquet")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_part(root, row["part"], row["width"])

    return parts.repartition("part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_part(root: str, part: int, width: int, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    path = f"{root}/part-{part:05d}"
    ids = np.memmap(f"{path}.ids", f"<u{width}", "r")
    offsets = np.memmap(f"{path}.offsets", "<u8", "r")
    docs = np.memmap(f"{path}.docs", "<i8", "r")
    base = int(offsets[0])
    for at in range(0, len(docs), rows):
        marks = offsets[at : at + rows + 1].astype("i8")
        sums = [
            zlib.crc32(ids[b - base : e - base].astype("<u4").tobytes())
            for b, e in zip(marks[:-1].tolist(), marks[1:].tolist())
        ]
        keys = np.array(docs[at : at + rows])
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(keys, pa.int64(), mask=keys == NULL_KEY),
            "start": pa.array(marks[:-1], pa.int64()), "n_tokens": pa.array(np.diff(marks), pa.int64()),
            "ids_crc32": pa.array(sums, pa.int64()),
        })


def open_ids(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Memory maps of one part for a training loader: its ids and its documents' global offsets."""
    path = f"{mounted(folder)}/part-{part:05d}"
    offsets = np.memmap(f"{path}.offsets", "<u8", "r")
    width = os.path.getsize(f"{path}.ids") // int(offsets[-1] - offsets[0])
    return np.memmap(f"{path}.ids", f"<u{width}", "r"), offsets


def parts_of(folder: str) -> list[int]:
    return sorted(int(p[-9:-4]) for p in glob.glob(f"{mounted(folder)}/part-*.ids"))


def _with_base(parts: DataFrame) -> DataFrame:
    """Prefix sums over the parts: one small row per part, not per document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
