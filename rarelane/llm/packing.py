"""Packing of tokenised documents into sequences by multiway differencing.

A document's ids are cut into full sequences and a rest.  The rests of a group
are shared out by the Karmarkar-Karp method over k partial partitions: the two
with the widest spread are merged so that the fullest part of one meets the
emptiest of the other, until one partition of near-equal windows is left.  k
starts at the fewest windows that can hold the group and rises while a window
exceeds the capacity.

A few large rests cannot be levelled, so every fourth rest is cut by halving: its
small pieces are merged last and level the windows.  A group is closed when its
windows are full but for one id each; the rest that reaches over is cut there.

A task packs its own documents group by group, so nothing is shuffled and a
group's memory is bounded.  Only a task's last group may be smaller: it leaves at
most about one sequence of padding for each task.

Null text: empty, a document of the end id alone.  Null or repeated keys: each
row is packed as a document.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rarelane.llm.tables import keyed_text, text_batches
from rarelane.llm.tokens import encoder

#: Windows of a full group, and which rests are cut by halving.
WINDOWS, HALVED = 64, 4
#: Sequences of one task are told apart by so many lower bits of a sequence id.
_TASK_BITS = 33
#: Pieces in one batch of a task's result.
_ROWS = 2048

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Positions of ``sizes`` shared over ``windows`` near-equal windows (Karmarkar-Karp).

    A partial partition is a list of at most ``windows`` parts (value, items), the
    largest first, with values counted from its smallest part; parts that are not
    listed are empty.
    """
    # the second field breaks ties, so that equal inputs give equal windows
    heap = [(-size, at, [(size, at)]) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        wide, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = max(0, windows - len(other))  # parts of wide that meet an empty part
        met = wide[alone:]
        merged = wide[:alone] + [
            (a + b, (x, y)) for (a, x), (b, y) in zip(met, reversed(other))
        ] + other[: len(other) - len(met)]
        merged.sort(key=_value, reverse=True)
        if len(merged) == windows and (least := merged[-1][0]):
            merged = [(value - least, items) for value, items in merged]
        heapq.heappush(heap, (-merged[0][0], made, merged))
        made += 1
    return [_flat(items) for _, items in heap[0][2]] if heap else []


def _value(part: tuple) -> int:
    return part[0]


def _flat(items) -> list[int]:
    out, rest = [], [items]
    while rest:
        x = rest.pop()
        if isinstance(x, tuple):
            rest.extend(x)
        else:
            out.append(x)
    return sorted(out)


def share_out(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of which none exceeds ``capacity``; no size may exceed it."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        windows += 1


def halved(size: int) -> list[int]:
    """Pieces of half, a quarter, ... of ``size``."""
    out = []
    while size > 1:
        out.append(size // 2)
        size -= size // 2
    return out + [size] * size


class Packer:
    """Packs the documents of one task; rows are tuples in the order of PIECES."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.full = WINDOWS * (capacity - 1)
        self.rests, self.size, self.seen = [], 0, 0

    def add(self, key: int | None, ids: bytes) -> Iterator[tuple]:
        """Rows that are settled by a document of little-endian 32-bit ids."""
        tokens = len(ids) // 4
        whole = tokens - tokens % self.capacity
        for start in range(0, whole, self.capacity):
            yield key, start, self.capacity, ids[4 * start : 4 * (start + self.capacity)], tokens, self.next_id, 0
            self.next_id += 1
        if whole == tokens:
            return
        sizes = halved(tokens - whole) if self.seen % HALVED == 0 else [tokens - whole]
        self.seen += 1
        start = whole
        for size in sizes:
            while size:
                part = min(size, self.full - self.size)
                self.rests.append((key, start, part, ids[4 * start : 4 * (start + part)], tokens))
                self.size, size, start = self.size + part, size - part, start + part
                if self.size == self.full:
                    yield from self.close()

    def close(self) -> Iterator[tuple]:
        rests, self.rests, self.size = self.rests, [], 0
        for window in share_out([r[2] for r in rests], self.capacity):
            offset = 0
            for at in window:
                yield *rests[at], self.next_id, offset
                offset += rests[at][2]
            self.next_id += 1


def pack_documents(
    docs: DataFrame, vocabulary: str, spaces: bool, end_id: int, capacity: int = 1024
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids, with their ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, spaces)
        end = np.asarray([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << _TASK_BITS)
        rows: list[tuple] = []
        for keys, texts in text_batches(batches):
            for key, ids in zip(keys, coder.encode(texts)):
                rows.extend(packer.add(key, ids + end))
                while len(rows) >= _ROWS:
                    yield _batch(rows[:_ROWS])
                    del rows[:_ROWS]
        rows.extend(packer.close())
        if rows:
            yield _batch(rows)

    return keyed_text(docs).mapInArrow(pack, PIECES)


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces in sequences of 1024 byte-level ids, each document closed by id 0, with checksums for the ids."""
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
