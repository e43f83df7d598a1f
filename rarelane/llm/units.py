"""Repeated passages, found by hashing runs of lines and sentences.

A text is cut at line ends and sentence ends, and in long sentences also behind
words chosen by their own hash, so a passage is cut alike wherever it stands.  At
each cut a unit begins: the pieces that follow, until they hold ``least`` words.
Units are normalised (lower case, white space as one space) and 96 bits of their
digests are grouped over all documents.  The occurrence in the document with the
smallest key, there the first one, is kept; the others are removed, by their
original offsets.  What belongs to a kept occurrence is never removed.

Offsets count code points.  Null or empty texts, and texts of fewer words, have no
units.  Each row is a document of its own; those without a key come first, and those
that share a key follow a digest of the row.  A passage inside one document can
repeat too.  An empty table gives no rows.  Other columns are carried by ``drop_repeats`` and not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rarelane.llm.tables import ROW, row_key, row_text, text_batches, with_rows
from rarelane.session import stage_table

#: Words of a unit at least; shorter lines that many documents share are left alone.
LEAST = 14
#: A longer sentence is also cut behind each word whose hash ends in two zero bits.
LONG = 12

#: Characters of text that a task works on at once.
CHARS = 1_000_000

_END = re.compile(r"[.!?]+(?=\s)|\n")
_WORD = re.compile(r"\S+")

UNITS = "row {row}, start int, stop int, again boolean, h1 long, h2 int"
ROW_SPANS = "row {row}, start int, length int, kept_row {row}, kept_start int"
SPANS = "doc_id long, start int, length int, kept_doc_id long, kept_start int"


def pieces(text: str) -> tuple[list[int], list[int], list[str], list[int]]:
    """Starts, stops, normalised texts and word counts of the pieces of ``text``."""
    starts, stops, texts, counts = [], [], [], []

    def add(begin: int, end: int) -> None:
        words = text[begin:end].lower().split()
        if len(words) <= LONG:
            if words:
                starts.append(begin)
                stops.append(end)
                texts.append(" ".join(words))
                counts.append(len(words))
            return
        first, own = begin, []
        for word in _WORD.finditer(text, begin, end):
            low = word[0].lower()
            own.append(low)
            if not zlib.crc32(low.encode("utf-8", "surrogatepass")) & 3:
                close(first, word.end(), own)
                first, own = word.end(), []
        if own:
            close(first, end, own)

    def close(begin: int, end: int, words: list[str]) -> None:
        starts.append(begin)
        stops.append(end)
        texts.append(" ".join(words))
        counts.append(len(words))

    at = 0
    for mark in _END.finditer(text):
        add(at, mark.end())
        at = mark.end()
    add(at, len(text))
    return starts, stops, texts, counts


def units(text: str, least: int = LEAST) -> tuple[list[int], list[int], list[bytes]]:
    """Starts, stops and digests of the units of ``text``."""
    from xxhash import xxh3_128_digest as digest

    starts, stops, texts, counts = pieces(text)
    ends = np.cumsum(counts) if counts else np.empty(0, np.int64)
    last = np.searchsorted(ends, ends - counts + least).tolist()
    n = len(starts)
    firsts = [i for i in range(n) if last[i] < n]
    return (
        [starts[i] for i in firsts],
        [stops[last[i]] for i in firsts],
        [digest(" ".join(texts[i : last[i] + 1]).encode("utf-8", "surrogatepass")) for i in firsts],
    )


def document_units(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """All units of ``with_rows``; ``again`` marks those that an earlier unit of the same row equals."""
    kind = rows.schema[ROW].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, CHARS):
            ids, starts, stops, again, digests = [], [], [], [], []
            for key, text in zip(keys, texts):
                s, e, d = units(text, least)
                seen: set[bytes] = set()
                again.extend([x in seen or bool(seen.add(x)) for x in d])
                ids.extend([key] * len(s))
                starts.extend(s)
                stops.extend(e)
                digests.extend(d)
            if ids:
                h = np.frombuffer(b"".join(digests), [("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string() if kind == "string" else pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                     pa.array(again, pa.bool_()), pa.array(h["h1"].copy()), pa.array(h["h2"].copy())],
                    ["row", "start", "stop", "again", "h1", "h2"],
                )

    return row_text(rows).mapInArrow(make, UNITS.format(row=kind))


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, start, length, kept_doc_id, kept_start`` of each span to remove."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, kept = ([row_key(x) for x in batch.column(c).to_pylist()] for c in ("row", "kept_row"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), batch.column("start"), batch.column("length"),
                 pa.array(kept, pa.int64()), batch.column("kept_start")],
                [c.split()[0] for c in SPANS.split(", ")],
            )

    found = row_spans(with_rows(docs), least)
    if found.schema["row"].dataType.simpleString() == "string":
        return found.mapInArrow(keys, SPANS)
    return found.withColumnsRenamed({"row": "doc_id", "kept_row": "kept_doc_id"})


def row_spans(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """``row, start, length, kept_row, kept_start`` of each span to remove from a row of ``with_rows``."""
    kind = rows.schema[ROW].dataType.simpleString()
    found = stage_table(document_units(rows, least), "units")
    # half a digest sorts out what is certainly unique, so that little is grouped by whole digests;
    # joined sides are read from staged tables, so that a digest of very many units can be split
    often = stage_table(found.groupBy("h1").count().where("count > 1").select("h1"), "often")
    found = stage_table(found.join(often, "h1"), "candidates")
    first = F.expr("min_by(start, row) FILTER (WHERE NOT again)")
    repeats = stage_table(
        found.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("row").alias("kept_row"), first.alias("kept_start"))
        .where("n > 1").drop("n"),
        "repeats",
    )
    hits = found.join(repeats, ["h1", "h2"]).select(
        "row", "start", "stop", (~F.col("again") & (F.col("row") == F.col("kept_row"))).alias("kept"),
        "kept_row", "kept_start",
    )
    listed = hits.groupBy("row").agg(
        F.collect_set(F.struct("start", "stop", "kept", "kept_row", "kept_start")).alias("units")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("units")
            fields = [c.to_pylist() for c in units.flatten().flatten()]
            ends = units.offsets.to_pylist()
            rows = []
            for key, begin, end in zip(batch.column("row").to_pylist(), ends, ends[1:]):
                own = sorted(zip(*(f[begin - ends[0] : end - ends[0]] for f in fields)))
                rows += [(key, *span) for span in spans(own)]
            own_kind = pa.string() if kind == "string" else pa.int64()
            kinds = (own_kind, pa.int32(), pa.int32(), own_kind, pa.int32())
            names = [c.split()[0] for c in ROW_SPANS.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return listed.mapInArrow(cut, ROW_SPANS.format(row=kind))


def spans(found: list[tuple]) -> Iterator[tuple]:
    """Removed units of one document joined to spans, without what its kept units cover.

    ``found``: start, stop, whether it is kept, place of the kept unit, in order of the starts.
    """
    kept = _joined([u[:2] for u in found if u[2]])
    gone = [u for u in found if not u[2]]
    at = unit = 0
    for begin, end in _joined([u[:2] for u in gone]):
        while begin < end:
            while at < len(kept) and kept[at][1] <= begin:
                at += 1
            stop = min(end, kept[at][0]) if at < len(kept) else end
            if stop > begin:
                while gone[unit][1] <= begin:  # stops rise with starts
                    unit += 1
                yield begin, stop - begin, gone[unit][3], gone[unit][4]
            begin = max(stop, kept[at][1]) if at < len(kept) and stop < end else end


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, in order of their starts, joined where they touch."""
    out: list[tuple[int, int]] = []
    for begin, end in ranges:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def drop_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text`` and ``n_chars`` counted anew.

    A document that consists of repeats keeps its row, with an empty text.
    """
    rows = with_rows(docs)
    listed = stage_table(
        row_spans(rows, least).groupBy(F.col("row").alias(ROW))
        .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__rarelane_spans")),
        "spans",
    )
    joined = rows.join(listed.hint("merge"), ROW, "left")  # grows with the table: never broadcast
    rest = F.expr("""
        CASE WHEN __rarelane_spans IS NULL THEN text ELSE
          aggregate(__rarelane_spans, named_struct('out', '', 'at', 0),
            (s, x) -> named_struct(
              'out', concat(s.out, substring(text, s.at + 1, x.start - s.at)), 'at', x.start + x.length),
            s -> concat(s.out, substring(text, s.at + 1)))
        END""")
    cut = F.col("__rarelane_spans").isNotNull()
    out = joined.withColumn("__rarelane_text", rest)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("__rarelane_text").alias("text"))
        elif name == "n_chars":
            count = F.length("__rarelane_text").cast(docs.schema[name].dataType)
            columns.append(F.when(cut, count).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(columns)
