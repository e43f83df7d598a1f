"""Documents that hold a benchmark item, whole or with a few edits.

Items and texts are compared in lower case with white space as one space.  An item
of m characters may differ from its place in a text by k = rate * m edits.  Cut into
k + 1 pieces, at least one piece stands in the text unchanged, so all texts are
scanned for the pieces of all items at once (Aho-Corasick), and the stretch around
each hit is verified with Myers' bit-parallel edit distance, which finds the best
place of the item in the stretch.

The items go to the tasks in chunks of bounded size, one scan of the texts for each
chunk; no chunk is left out.

Null or empty texts hold nothing, null or empty items are found nowhere.  Rows
without a key, and rows that repeat one, are compared like any other.  Repeated
items are reported each under its own id.  An empty table on either side gives no
rows.  Other columns are carried by ``drop_contaminated`` and not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rarelane.llm.tables import keyed_text, text_batches

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of items that a task scans for at once.
CHUNK_CHARS = 8_000_000

HITS = "doc_id long, item_id long, distance int, start int, length int"


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def cut_item(item: str, rate: float = RATE) -> Iterator[tuple[int, str]]:
    """Offset and text of each of the budget-plus-one pieces."""
    count = int(len(item) * rate) + 1
    marks = [i * len(item) // count for i in range(count + 1)]
    for begin, end in zip(marks, marks[1:]):
        yield begin, item[begin:end]


def best_place(item: str, text: str, budget: int, free: bool = True) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``item`` in ``text``, the first of equals; None beyond the budget.

    Myers' bit-parallel distance: two bit vectors hold a column's vertical steps up
    and down, and one addition gives the next column.  The place may begin anywhere
    if ``free``, else at the first character.
    """
    m = len(item)
    marks: dict[str, int] = {}
    for i, c in enumerate(item):
        marks[c] = marks.get(c, 0) | 1 << i
    full, top, low = (1 << m) - 1, 1 << (m - 1), 0 if free else 1
    up, down, edits = full, 0, m
    best = (m, 0)
    for at, c in enumerate(text, 1):
        equal = marks.get(c, 0)
        steady = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(across | up), up & across
        if rise & top:
            edits += 1
        elif fall & top:
            edits -= 1
        rise, fall = rise << 1 | low, fall << 1
        up, down = (fall | ~(steady | rise)) & full, rise & steady & full
        if edits < best[0]:
            best = (edits, at)
    return best if best[0] <= budget else None


class Scanner:
    """Finds items (id, folded text) in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        from ahocorasick import Automaton

        self.items, self.rate = items, rate
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (_, item) in enumerate(items):
            for offset, piece in cut_item(item, rate):
                places.setdefault(piece, []).append((at, offset))
        self.find = Automaton()
        for piece, found in places.items():
            self.find.add_word(piece, (len(piece), found))
        self.find.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item's place, edits, begin, end) in the folded text, the best of each item."""
        stretches: dict[int, list[list[int]]] = {}
        for last, (size, found) in self.find.iter(text):
            for at, offset in found:
                m = len(self.items[at][1])
                spare = int(m * self.rate)
                begin = last + 1 - size - offset
                own = stretches.setdefault(at, [])
                stretch = [max(0, begin - spare), begin + m + spare]
                if own and stretch[0] <= own[-1][1]:
                    own[-1] = [min(own[-1][0], stretch[0]), max(own[-1][1], stretch[1])]
                else:
                    own.append(stretch)
        for at, own in stretches.items():
            item = self.items[at][1]
            place = text.find(item)
            if place >= 0:
                yield at, 0, place, place + len(item)
                continue
            spare, best = int(len(item) * self.rate), None
            for begin, end in own:
                got = best_place(item, text[begin:end], spare)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], begin + got[1]
            if best:
                edits, end = best
                back = best_place(item[::-1], text[max(0, end - len(item) - spare) : end][::-1], edits, False)
                yield at, edits, end - back[1], end


def original_span(text: str, begin: int, end: int) -> tuple[int, int]:
    """Start and length in ``text`` of a stretch of its folded form."""
    at, first, last = 0, None, 0
    for word in re.finditer(r"\S+", text):
        size = len(word[0].lower())
        if first is None and begin < at + size:
            first = word.start() + min(max(0, begin - at), len(word[0]) - 1)
        if at < end:
            last = word.start() + min(end - at, len(word[0]))
        at += size + 1
        if at >= end:
            break
    return first or 0, last - (first or 0)


_SCANNERS: dict = {}


def _scanner(sent, rate: float) -> Scanner:
    """One scanner per Python worker, that of the chunk scanned last."""
    if (sent.value[0], rate) not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[sent.value[0], rate] = Scanner(sent.value[1], rate)
    return _SCANNERS[sent.value[0], rate]


def _chunks(items: DataFrame, key: str, text: str) -> Iterator:
    """Broadcast (mark, items) chunks of about CHUNK_CHARS characters, all of them."""
    spark = items.sparkSession
    rows = items.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    ).where(F.length("text") > 0)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // CHUNK_CHARS)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, count)))
    for at in range(count):
        some = sorted((r["id"] is None, r["id"] or 0, folded(r["text"])) for r in rows.where(part == at).collect())
        some = [(None if none else key, text) for none, key, text in some if text]
        if some:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, some))


def contaminated(
    docs: DataFrame, items: DataFrame, rate: float = RATE, key: str = "item_id", text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, distance, start, length``: the best place of each item found in a document."""
    found = None
    for sent in _chunks(items, key, text):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(sent, rate)
            for keys, texts in text_batches(batches):
                rows = [
                    (doc, scanner.items[at][0], edits, *original_span(t, begin, end))
                    for doc, t in zip(keys, texts)
                    for at, edits, begin, end in scanner.hits(folded(t))
                ]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    names = [c.split()[0] for c in HITS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        hits = keyed_text(docs).mapInArrow(scan, HITS)
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def drop_contaminated(
    docs: DataFrame, items: DataFrame, rate: float = RATE, key: str = "item_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged."""
    for sent in _chunks(items, key, text):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(sent, rate)
            for batch in batches:
                stays = [
                    not (t and any(True for _ in scanner.hits(folded(t))))
                    for t in batch.column("text").cast(pa.string()).to_pylist()
                ]
                yield batch.filter(pa.array(stays, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
