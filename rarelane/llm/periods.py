"""Runs of words that repeat with a period, found in tiles of every scale.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
equal), of LEAST words and TIMES periods at least, that no neighbouring word
extends with that period.  Its places i with word i = word i + q are one interval of
(TIMES - 1) q places or more.

Octave k looks for the periods from 2^k to 2^(k+1) - 1.  Boundaries stand every
s = (TIMES - 1) 2^k words, so such an interval holds one at least; a boundary's tile
reaches s words to its left, and s and two octaves to its right.  Inside a tile two
Z-functions, from the boundary forward and backward, give for each period how far words
agree on both sides: a fragment of the interval.  What ends inside its tile is a whole
interval; what reaches a tile's edge goes on in the next tile.  Fragments are shuffled by
(document, period) and joined where they touch.

A tile is made only where a few words beside the boundary come again at a distance of
the octave, which holds for every fragment that is needed, and where the tile as a whole
has no smaller period, which rules out a smallest period of the octave (Fine and Wilf).
Neighbouring tiles travel as one strip of at most STRIP words or of one tile, so a long
text is solved by many tasks.

Null or empty text: no words and no runs.  A null key is never chosen for periodic
rewriting.  Repeated rows and keys are documents of their own.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rarelane.llm.tables import ROW, key_column, row_key, row_text, text_batches, with_rows
from rarelane.session import stage_table

#: Words and periods of a run at least.
LEAST, TIMES = 6, 4
#: Words of neighbouring tiles that travel together.
STRIP = 4096
#: Words beside a boundary that must come again, by octave; the last holds for all higher ones.
GRAMS = (2, 3, 4)

_RUN = "start: bigint, period: bigint, length: bigint"
_TILED = "row {row}, n long, collapsed string, text string, octave int, first long, size long, words binary"

I64, U64 = np.int64, np.uint64


class Words:
    """The words of some texts, in the order and the places that their documents give them."""

    def __init__(self, keys: list, texts: list[str]):
        trimmed = pc.ascii_trim_whitespace(pa.array(texts, pa.large_string()))
        lists = pc.ascii_split_whitespace(trimmed)
        empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        self.values = lists.flatten().filter(pa.array(np.repeat(~empty, sizes)))
        self.counts = np.where(empty, 0, sizes).astype(I64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        places = [rewritten(k, n) for k, n in zip(keys, self.counts.tolist())]
        if any(p is not None for p in places):
            order = np.arange(len(self.values))
            for place, begin, end in zip(places, self.starts.tolist(), self.ends.tolist()):
                if place is not None:
                    order[begin:end] = begin + place
            self.values = self.values.take(pa.array(order))

    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        if not len(self.values):
            return np.empty(0, np.int32)
        return self.values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)

    def joined(self, i: int, kept: np.ndarray | None = None) -> bytes:
        """Words of document i, or those that are kept, with single spaces."""
        own = self.values.slice(self.starts[i], self.counts[i])
        own = own if kept is None else own.filter(pa.array(kept))
        line = pa.LargeListArray.from_arrays(pa.array([0, len(own)], pa.int64()), own)
        return pc.binary_join(line, pa.scalar(" ", pa.large_string()))[0].as_py().encode("utf-8")


def rewritten(key: int | None, n: int) -> np.ndarray | None:
    """Places of the original words, for the documents that are made periodic; else None.

    With h the crc32 of the decimal key and g = h div 10: if h mod 10 is 0, word i >= a
    becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def reach(octave: int) -> int:
    """Words between two boundaries."""
    return (TIMES - 1) << octave


class Recurrences:
    """Places whose next ``wide`` words come again in the same document."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, wide: int):
        n = max(0, len(codes) - wide + 1)
        mixed = owner[:n].astype(U64)
        for i in range(wide):  # a chance hit only costs a tile
            mixed = (mixed ^ codes[i : i + n].astype(U64)) * U64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> U64(29)
        inside = np.flatnonzero(owner[:n] == owner[len(codes) - n :])
        mixed = mixed[inside]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        often = often[: len(order)]
        group = np.cumsum(np.concatenate([[False], ~same]))[: len(order)][often]
        self.places = inside[order][often]
        self.keys = group * (4 * len(codes) + 8) + self.places
        self.next = np.zeros(len(codes), I64)  # distance to the next such place; 0: none
        ahead = np.flatnonzero(group[1:] == group[:-1])
        self.next[self.places[ahead]] = self.places[ahead + 1] - self.places[ahead]

    def within(self, some: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the places numbered ``some`` come again at a distance from low to high - 1."""
        own = self.keys[some]
        at = np.searchsorted(self.keys, own + low)
        beyond = at == len(self.keys)
        return ~beyond & (self.keys[np.where(beyond, 0, at)] < own + high)


def tiles(codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, octave, first boundary, boundaries) of strips of tiles that can hold a fragment.

    ``codes``: the words of all documents one after the other.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    seen, wide = None, 0
    for octave in range((int(counts.max(initial=0)) // TIMES).bit_length()):
        low, high, step = 1 << octave, 2 << octave, reach(octave)
        if wide != GRAMS[min(octave, len(GRAMS) - 1)]:
            wide = GRAMS[min(octave, len(GRAMS) - 1)]
            seen = Recurrences(codes, owner, wide)
        local = seen.places - starts[owner[seen.places]]
        found = []
        for shift in (0, wide):  # the words behind a boundary, and those before it
            some = np.flatnonzero((local + shift) % step == 0)
            found.append(seen.places[some[seen.within(some, low, high)]] + shift)
        at = np.unique(np.concatenate(found))
        open_tiles = []
        for b in at.tolist():
            d = owner[b]  # words before b come again behind it, so b is a word of the same document
            begin, end = max(starts[d], b - step), min(ends[d], b + step + high)
            less = seen.next[begin]
            if not less or less >= low or not np.array_equal(codes[begin + less : end], codes[begin : end - less]):
                open_tiles.append((int(d), b - int(starts[d])))
        first = None
        for d, b in open_tiles:
            if first and (d, b // max(step, STRIP)) == (first[0], first[1] // max(step, STRIP)) and b == first[1] + size * step:
                size += 1
                continue
            if first:
                yield first[0], octave, first[1], size
            first, size = (d, b), 1
        if first:
            yield first[0], octave, first[1], size


def z_function(words: list[int]) -> list[int]:
    """For each place, how many words from there on equal those from the beginning."""
    n = len(words)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(4096)
def divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def tile_fragments(words: list[int], begin: int, n: int, octave: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) of the places equal to the place a period behind, around boundary b.

    ``words``: those of the text from place ``begin``; n: words of the text.
    """
    step, low, high = reach(octave), 1 << octave, 2 << octave
    left, end = max(0, b - step), min(n, b + high - 1)
    ahead = z_function(words[b - begin : min(n, b + step + high - 1) - begin])
    own = words[left - begin : b - begin][::-1]
    behind = z_function([*own, -1, *words[left - begin : end - begin][::-1]])
    for q in range(low, min(high, n - b + 1)):
        forward = min(step, ahead[q]) if q < len(ahead) else 0
        backward = behind[len(own) + 1 + end - b - q]
        size = forward + backward
        on = forward == step or (left and backward == len(own))
        if not size or not on and size < max(LEAST - q, (TIMES - 1) * q):
            continue
        if any(ahead[p] >= q - p for p in divisors(q)):
            continue  # a power of a shorter stretch: its smallest period is less than q
        yield q, b - backward, b + forward


def strip_fragments(words: list[int], n: int, octave: int, first: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Fragments of a strip of tiles, joined where they touch."""
    step = reach(octave)
    begin = max(0, first - step)
    held: dict[int, tuple[int, int]] = {}
    for b in range(first, first + size * step, step):
        for q, start, stop in tile_fragments(words, begin, n, octave, b):
            if q in held:
                if start <= held[q][1]:
                    start, stop = held[q][0], max(stop, held[q][1])
                else:
                    yield q, *held[q]
            held[q] = start, stop
    for q, span in held.items():
        yield q, *span


def _tiled(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Digest of a document without tiles; else the document, and a row for each of its strips."""
    names = [c.split()[0] for c in _TILED.split(", ")]
    kinds = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for rows, texts in text_batches(batches):
        words = Words([row_key(r) for r in rows], texts)
        codes = words.codes()
        found, out, size = set(), [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for d, octave, first, count in tiles(codes, words.counts):
            found.add(d)
            n, step = int(words.counts[d]), reach(octave)
            begin, end = max(0, first - step), min(n, first + count * step + (2 << octave))
            own = codes[words.starts[d] + begin : words.starts[d] + end].tobytes()
            out.append((rows[d], n, None, None, octave, first, count, own))
            size += len(own)
            if size > 1 << 24:
                yield batch()
                out, size = [], 0
        for d, (row, n) in enumerate(zip(rows, words.counts.tolist())):
            digest = None if d in found else hashlib.sha256(words.joined(d)).hexdigest()
            out.append((row, n, digest, texts[d] if d in found else None, None, None, None, None))
        if out:
            yield batch()


def _solved(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    names = ["row", "period", "start", "stop"]
    kinds = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("row", "n", "octave", "first", "size", "words")]
        for i in range(batch.num_rows):
            row, n, octave, first, size, data = (c[i].as_py() for c in columns)
            words = np.frombuffer(data, np.int32).tolist()
            out += [(row, *f) for f in strip_fragments(words, n, octave, first, size)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def stitched(fragments: DataFrame) -> DataFrame:
    """``row, start, length, period`` of the runs: fragments of one text and period joined where they touch."""
    own = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return (
        fragments.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int"))
        .withColumn("lot", F.sum("new").over(own))
        .groupBy("row", "period", "lot").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")
        .where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    )


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run (start, length, period) contains behind its first period."""
    steps = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def _collapsed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Digests of the documents that had tiles, from their texts and their runs."""
    for batch in batches:
        rows, texts = batch.column("row").to_pylist(), batch.column("text")
        runs = batch.column("runs")
        digests = []
        for i, row in enumerate(rows):  # one text at a time, so that memory is bounded by a text
            words = Words([row_key(row)], [texts[i].as_py()])
            own = [(r["start"], r["length"], r["period"]) for r in runs[i].as_py() or []]
            digests.append(hashlib.sha256(words.joined(0, kept_words(int(words.counts[0]), own))).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(digests, pa.string()), runs], ["row", "collapsed", "runs"]
        )


def document_runs(rows: DataFrame) -> DataFrame:
    """``row, runs, collapsed`` of each row of ``with_rows``.

    ``runs``: array of (start, period, length), in this order; null if there is none.
    ``collapsed``: sha256 of the words that are left when each run keeps its first period.
    """
    kind = rows.schema[ROW].dataType.simpleString()
    tiled = stage_table(row_text(rows).mapInArrow(lambda b: _tiled(b, kind), _TILED.format(row=kind)), "tiles")
    strips = tiled.where("octave IS NOT NULL").select("row", "n", "octave", "first", "size", "words")
    fragments = strips.repartition("row", "octave", "first").mapInArrow(
        lambda b: _solved(b, kind), f"row {kind}, period long, start long, stop long"
    )
    runs = stage_table(
        stitched(fragments).groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")),
        "runs",
    )
    whole = tiled.where("octave IS NULL")
    open_rows = whole.where("text IS NOT NULL").select("row", "text").join(runs.hint("merge"), "row", "left")  # grows with the table: never broadcast
    solved = open_rows.mapInArrow(
        lambda b: _collapsed(b, kind), f"row {kind}, collapsed string, runs array<struct<{_RUN}>>"
    )
    plain = whole.where("text IS NULL").select("row", "collapsed", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    return plain.unionByName(solved)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text.

    The longest run is the first of the least period among those of most words; without runs
    its start, length, period and exponent_milli are null.
    """
    found = document_runs(with_rows(docs))
    found = found.withColumn("doc_id", key_column(found, "row"))
    runs = F.coalesce("runs", F.array().cast(found.schema["runs"].dataType))
    best = F.expr("""
        aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, period: BIGINT, length: BIGINT>),
          (b, x) -> CASE WHEN b IS NULL OR x.length > b.length THEN x ELSE b END)""")
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    lines = F.transform(lines, lambda x: F.concat(x, F.lit("\n")))
    return (
        found.withColumn("runs", runs).withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
        )
    )
