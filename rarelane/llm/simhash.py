"""Near-copies by SimHash fingerprints, compared as vertical bit planes.

Fingerprint: XXH64 (seed 42) of each shingle of words, repeats included; a bit is
set if it is set in over half of the hashes.

Search: fingerprints that differ in at most r bits agree in one of r + 1 blocks of
bits, so distinct fingerprints meet in a bucket for each block.  A bucket that is
too large for a task is cut again by the same rule over the bits that are left,
which loses no link.  Inside a bucket, plane p holds bit p of 64 fingerprints a
word; a query's differences are summed by carry-save adders into counter planes
over all words at once, and queries whose words are all beyond the radius are
abandoned.  A bucket gives one link per linked fingerprint (to the first of its
group), not all pairs.

Null text: empty.  A text without words has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle.  Null keys are kept: they never
name a component unless all its keys are null.  Repeated keys give a row each.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rarelane.llm.components import components
from rarelane.llm.tables import ROW, keyed_text, row_text, text_batches, with_rows, without_key
from rarelane.session import stage_table

#: Rows of a bucket that a task compares; larger buckets are cut again.
BUCKET = 4096
#: Rows compared together, and queries whose counters are held at once.
BLOCK, QUERIES_AT_ONCE = 1024, 512

#: A bucket whose fingerprints differ in at most so many bits is small.
_FEW_BITS = 12

#: Characters of text that a task works on at once.
CHARS = 1_000_000

U64 = np.uint64


def fingerprints(texts: list[str], words: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    counts = []
    for text in texts:
        parts = text.encode("utf-8", "surrogatepass").lower().split()
        joined = b" ".join(parts)
        if len(parts) <= words:
            found = [digest(joined, 42)] if parts else []
        else:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            starts = [0, *ends[: len(parts) - words].tolist()]
            found = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())]
        hashes.extend(found)
        counts.append(len(found))
    return _majority(np.array(hashes, U64), np.array(counts, np.int64))


def _majority(hashes: np.ndarray, counts: np.ndarray, rows: int = 1 << 17) -> np.ndarray:
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), rows):
        bits = np.unpackbits(hashes[at : at + rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + rows]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.uint32)
    bits = (2 * total > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _add(a, b, c):
    """Carry-save adder: sums and carries of three bit vectors."""
    both = a ^ b
    return both ^ c, (a & b) | (both & c)


def _beyond(radius: int, ones, twos, fours, over):
    """Bits of the places whose count is over ``radius`` (at most 7)."""
    out = over.copy()
    equal = ~over
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal &= plane
        else:
            out |= equal & plane
            equal &= ~plane
    return out


def first_linked(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the place of the first one of its linked group."""
    n = len(prints)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    width = -(-n // 64)
    padded = np.zeros((64, width * 64), np.uint8)
    padded[:, :n] = bits
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    flips = np.where(bits, U64(0xFFFFFFFFFFFFFFFF), U64(0))
    places = np.arange(width * 64)
    group = np.arange(n)
    for begin in range(0, n, QUERIES_AT_ONCE):
        rows = np.arange(begin, min(n, begin + QUERIES_AT_ONCE))
        # what lies at or before the query, or behind the last row, is no partner
        closed = np.packbits(
            (places[None, :] <= rows[:, None]) | (places >= n)[None, :], axis=1, bitorder="little"
        ).view("<u8")
        ones, twos, fours, over = (np.zeros((len(rows), width), U64) for _ in range(4))
        for p in range(0, 64, 4):
            a, b, c, d = (planes[q][None, :] ^ flips[q][rows][:, None] for q in range(p, p + 4))
            ones, carry = _add(ones, a, b)
            ones, carried = _add(ones, c, d)
            twos, four = _add(twos, carry, carried)
            over |= fours & four
            fours ^= four
            if p % 12 == 8 or p == 60:
                past = _beyond(radius, ones, twos, fours, over) | closed
                open_rows = np.flatnonzero((past != U64(0xFFFFFFFFFFFFFFFF)).any(axis=1))
                if len(open_rows) < len(rows):
                    rows = rows[open_rows]
                    ones, twos, fours, over, closed, past = (
                        x[open_rows] for x in (ones, twos, fours, over, closed, past)
                    )
                if not len(rows):
                    break
        if len(rows):
            near = np.unpackbits((~past).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            group = _merge(group, rows[i], j)
    return group


def _merge(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Groups joined by links i - j, named by their first place."""
    while True:
        least = np.minimum(group[i], group[j])
        new = group.copy()
        np.minimum.at(new, group[i], least)
        np.minimum.at(new, group[j], least)
        while not np.array_equal(new, deeper := new[new]):
            new = deeper
        if np.array_equal(new[i], new[j]) and np.array_equal(new, group):
            return new
        group = new


def _blocks(mask: int, radius: int) -> list[np.ndarray]:
    """The bits outside ``mask``, in radius + 1 runs of near-equal length."""
    left = np.array([b for b in range(64) if not mask >> b & 1])
    return np.array_split(left, radius + 1)


def cut_buckets(prints: np.ndarray, keys: np.ndarray, masks: np.ndarray, radius: int):
    """(key, mask, print) of each fingerprint in the radius + 1 buckets below its own."""
    out = []
    for mask in np.unique(masks).tolist():
        rows = np.flatnonzero(masks == U64(mask))
        for at, block in enumerate(_blocks(mask, radius)):
            taken = U64(sum(1 << int(b) for b in block))
            key = (keys[rows] * U64(0x9E3779B97F4A7C15)) ^ (prints[rows] & taken)
            key = _mix(key + U64(at + 1))
            out.append((key, np.full(len(rows), U64(mask) | taken), prints[rows]))
    return [np.concatenate(x) for x in zip(*out)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble; buckets that meet by chance only cost comparisons."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> U64(29))


def _cut(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            prints, keys, masks = (
                batch.column(c).to_numpy().view(U64) for c in ("print", "key", "mask")
            )
            key, mask, found = cut_buckets(prints, keys, masks, radius)
            yield _longs(key=key, mask=mask, print=found)


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64)) for k, v in columns.items()})


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a task, whose rows come ordered by key."""
    keys = prints = np.empty(0, U64)

    def linked(prints: np.ndarray):
        group = first_linked(prints, radius)
        other = np.flatnonzero(group != np.arange(len(group)))
        return _longs(a=prints[other], b=prints[group[other]])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy().view(U64)])
        prints = np.concatenate([prints, batch.column("print").to_numpy().view(U64)])
        while True:
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # whole buckets only
            if not len(ends) or ends[-1] < BLOCK:
                break
            fit = np.searchsorted(ends, BLOCK, "right")
            end = ends[max(0, fit - 1)]
            yield linked(_distinct(prints[:end]))
            keys, prints = keys[end:], prints[end:]
    if len(prints):
        yield linked(_distinct(prints))


def print_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints (column ``print``) within ``radius`` bits.

    Three counter planes hold distances up to 7; a larger radius is an error.
    """
    if not 0 <= radius <= 7:
        raise ValueError(f"radius {radius}: 0 to 7 bits")
    rows = prints.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("mask"), "print")
    found = None
    while True:
        rows = stage_table(rows.mapInArrow(lambda b: _cut(b, radius), "key long, mask long, print long"), "buckets")
        # distinct fingerprints that few bits tell apart are few
        cut = rows.where(F.bit_count("mask") < 64 - _FEW_BITS)
        large = stage_table(cut.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "large")
        some_large = not large.isEmpty()
        fitting = rows.join(large, "key", "left_anti") if some_large else rows
        links = stage_table(
            fitting.select("key", "print").repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda b: _compare(b, radius), "a long, b long"),
            "links",
        )
        found = links if found is None else found.union(links)
        if not some_large:
            return found
        rows = rows.join(large, "key", "left_semi").select("key", "mask", "print")


def document_prints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, print`` (signed 64-bit) of each row."""
    return _prints(keyed_text(docs), words)


def _prints(texts: DataFrame, words: int) -> DataFrame:
    """Prints of rows ``doc_id, text``, whatever the type of the first."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, CHARS):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.string() if kind == "string" else pa.int64()),
                "print": pa.array(fingerprints(texts, words).view(np.int64)),
            })

    return texts.mapInArrow(make, f"doc_id {kind}, print long")


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, print, component_id`` of each row: the smallest key it reaches through links."""
    prints = stage_table(document_prints(docs, words), "prints")
    classes = stage_table(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    roots = stage_table(components(print_links(classes.select("print"), radius)), "roots")
    grouped = classes.join(roots.withColumnRenamed("node", "print"), "print").select("print", "root", "least")
    smallest = stage_table(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    linked = stage_table(
        roots.join(smallest, "root").select(F.col("node").alias("print"), "component_id"), "linked"
    )
    named = stage_table(
        classes.join(linked, "print", "left")
        .select("print", F.coalesce("component_id", "least").alias("component_id")),
        "named",
    )
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The first row of each group of near-copies, unchanged: smallest key, then smallest row digest.

    Groups are those of ``near_copies``.  Rows that share a key but are not linked are in
    groups of their own.  Of a group's rows without a key, which cannot be named, one
    stays besides the first row with a key.
    """
    keyed = with_rows(docs)
    prints = stage_table(_prints(row_text(keyed), words), "prints")
    links = print_links(prints.select("print").distinct(), radius)
    roots = stage_table(components(links), "roots").withColumnRenamed("node", "print")
    keep = stage_table(
        prints.join(roots, "print", "left")
        .groupBy(F.coalesce("root", "print"), without_key(prints, "doc_id"))
        .agg(F.min("doc_id").alias(ROW)).select(ROW),
        "keep",
    )
    # kept rows grow with the table: never broadcast
    return keyed.join(keep.hint("merge"), ROW, "left_semi").select(docs.columns)
