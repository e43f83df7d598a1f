"""Ranked lexical search by a pipeline of term owners.

Terms are dealt to owners by how many documents hold them, rarest first: the last owner
has the terms in more than an eighth of the documents, the one before those in more
than a 64th, and so on.  Items travel from owner to owner with sparse accumulators, the
documents met so far with their sums.  At each owner the accumulators and the owner's
postings are cogrouped, and integer contributions are added.  Documents are dealt to
blocks of bounded size by a hash, so a bundle (block, item) is small, whatever the
table's size and however common a term is.

What cannot be among an item's best is not carried, which changes no answer: an item's
bar is the sum of its last wanted document so far, and a document whose sum and the
largest contributions of all later owners stay below the bar is left out; later owners
open no accumulators that must stay below it.  The last owner's best of each block
are ranked.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased.  Contributions are 64-bit integers, so sums do not depend on any order.

Null text: no terms.  Items and documents without terms have no rows.  Repeated rows and
keys are documents and items of their own, ranked by key, null keys first, then by a
digest of the row.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rarelane.llm.tables import ROW, key_column, row_text, with_rows
from rarelane.session import stage_table

#: Owners of terms, and by how much more common the terms of the next one are.
OWNERS, FACTOR = 4, 8
#: Documents of a block, which a task holds the accumulators and postings of.
BLOCK = 8192
#: Terms that the tasks of one scan look for; more are found by further scans.
TERMS = 200_000
#: Bytes of a term that are sent as they are; of longer ones a digest is.
LONG = 64
#: Bytes of text that a task cuts into terms at once.
BATCH_BYTES = 4_000_000

#: Separators become blanks, A-Z small letters; all other bytes stay.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)

I64 = np.int64


def text_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of large strings, one text after the other, and how many each has."""
    texts = pa.concat_arrays([texts])  # without an offset
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD))
    folded = pa.LargeStringArray.from_buffers(len(texts), offsets, folded)
    trimmed = pc.ascii_trim_whitespace(folded)
    lists = pc.ascii_split_whitespace(trimmed)
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().filter(pa.array(np.repeat(~empty, sizes))), np.where(empty, 0, sizes).astype(I64)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of at most BATCH_BYTES, or of one longer text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + BATCH_BYTES, "right")))
            yield batch.column("doc_id").slice(at, stop - at), texts.slice(at, stop - at)
            at = stop


def _named(terms: pa.Array) -> pa.Array:
    """Terms of bounded length: long ones by a digest, with a mark that no term holds."""
    lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    if not len(lengths) or lengths.max() <= LONG:
        return terms
    names = [t if len(t.encode()) <= LONG else " " + hashlib.sha256(t.encode()).hexdigest() for t in terms.to_pylist()]
    return pa.array(names, pa.large_string())


def item_terms(items: DataFrame) -> DataFrame:
    """``item, term``: the distinct terms of each row of ``with_rows``."""
    kind = items.schema[ROW].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _lots(batches):
            terms, counts = text_terms(texts)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            pairs = pa.table({"item": owner, "term": terms}).group_by(["item", "term"]).aggregate([])
            names = _named(pairs.column("term").combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pairs.column("item").combine_chunks()), names.cast(pa.string())], ["item", "term"]
            )

    return row_text(items).mapInArrow(make, f"item {kind}, term string")


class Vocabulary:
    """Some terms by their names, numbered from ``base``, as tasks look them up."""

    def __init__(self, names: list[str], base: int):
        self.names, self.base = pa.array(names, pa.large_string()), base

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of terms of each text, and (text, term, occurrences) of the known terms."""
        terms, counts = text_terms(texts)
        if not len(terms) or not len(self.names):
            return counts, *[np.empty(0, I64)] * 3
        coded = terms.dictionary_encode()
        place = pc.fill_null(pc.index_in(_named(coded.dictionary), self.names), -1)
        own = place.to_numpy(zero_copy_only=False).astype(I64)[coded.indices.to_numpy(zero_copy_only=False)]
        wanted = np.flatnonzero(own >= 0)
        owner = np.repeat(np.arange(len(counts)), counts)[wanted]
        pair, tf = np.unique(owner * len(self.names) + own[wanted], return_counts=True)
        return counts, pair // len(self.names), pair % len(self.names), tf


def corpus_counts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``term, df, size``: documents that hold each term; term null: documents with terms, and all terms."""

    def make(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
        n = size = 0
        df = np.zeros(len(known.names), I64)
        for _, texts in _lots(batches):
            counts, _, term, _ = known.pairs(texts)
            n, size = n + int((counts > 0).sum()), size + int(counts.sum())
            df += np.bincount(term, minlength=len(df))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(term + known.base).tolist()], pa.int32()), pa.array([n, *df[term].tolist()], pa.int64()),
             pa.array([size, *[None] * len(term)], pa.int64())],
            ["term", "df", "size"],
        )

    found = _scans(rows, names, make, "term int, df long, size long")
    # every scan counts the documents anew
    scans = max(1, -(-names.count() // TERMS))
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).select(
        "term", *[F.when(F.col("term").isNull(), F.call_function("div", F.col(c), F.lit(scans).cast("long"))).otherwise(F.col(c)).alias(c) for c in ("df", "size")]
    )


def postings(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``row, n, term, tf`` of the numbered terms; n: all terms of the document."""
    kind = rows.schema[ROW].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
        for keys, texts in _lots(batches):
            counts, owner, term, tf = known.pairs(texts)
            if len(owner):
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner)), pa.array(counts[owner]),
                     pa.array((term + known.base).astype(np.int32)), pa.array(tf.astype(I64))],
                    ["row", "n", "term", "tf"],
                )

    return _scans(rows, names, make, f"row {kind}, n long, term int, tf long")


def _scans(rows: DataFrame, names: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` gives for the texts of ``rows``, by a scan for each TERMS of the names."""
    texts, out = row_text(rows), None
    for base in range(0, max(1, names.count()), TERMS):
        some = names.where(F.col("term").between(base, base + TERMS - 1)).orderBy("term").collect()
        # TERMS names of bounded length
        sent = rows.sparkSession.sparkContext.broadcast(([r["name"] for r in some], base))
        found = texts.mapInArrow(lambda b, sent=sent: make(b, Vocabulary(*sent.value)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def numbered(terms: DataFrame) -> DataFrame:
    """``name, term``: distinct names numbered from 0, without a sort in one task."""
    names = stage_table(
        terms.select(F.col("term").alias("name")).distinct()
        .withColumn("part", F.spark_partition_id()), "names",
    )
    within = names.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    counts = names.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return stage_table(
        within.join(bases, "part").select("name", (F.col("base") + F.col("place") - 1).cast("int").alias("term")), "numbered"
    )


def contribution(weight: Column, tf: Column, m: Column) -> Column:
    """What a term adds to a document's score; all are long."""
    return weight * F.call_function("div", 1_000_000_000 * tf, 1000 * tf + 8 * m)


def _owner(df: Column, n: Column) -> Column:
    """Number of the owner of a term in ``df`` of n documents: the last has the most common terms."""
    out = F.lit(0)
    for step in range(OWNERS - 1, 0, -1):
        out = out + (df * FACTOR**step > n).cast("int")
    return out


def best_matches(docs: DataFrame, items: DataFrame, wanted: int = 10, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``item, rank, row, score``: rows of ``with_rows`` of each item's best documents, highest score first."""
    rows = with_rows(docs, doc_key)
    asked = with_rows(items.withColumn("text", F.col("text").cast("string")), item_key)
    terms = stage_table(item_terms(asked), "item_terms")
    names = numbered(terms)
    kinds = rows.schema[ROW].dataType.simpleString(), asked.schema[ROW].dataType.simpleString()
    empty = f"item {kinds[1]}, rank int, row {kinds[0]}, score long"
    if names.isEmpty():
        return docs.sparkSession.createDataFrame([], empty)
    counted = stage_table(corpus_counts(rows, names), "counts")
    whole = counted.where("term IS NULL").first()
    if whole is None or not whole["df"]:
        return docs.sparkSession.createDataFrame([], empty)
    n, size = (F.lit(whole[c]).cast("long") for c in ("df", "size"))
    weight = F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    stats = stage_table(
        counted.where("term IS NOT NULL").select("term", weight.alias("weight"), _owner(F.col("df"), n).alias("owner")),
        "weights",
    )
    m = 100 - 90 + F.call_function("div", 90 * F.col("n") * n, size)
    blocks = -(-whole["df"] // BLOCK)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    added = stage_table(
        postings(rows, names).join(stats, "term").select(
            block, "owner", "term", "row", contribution(F.col("weight"), F.col("tf"), m).alias("score")
        ),
        "contributions",
    )
    most = added.groupBy("term").agg(F.max("score").alias("most"))
    plan = stage_table(
        terms.withColumnRenamed("term", "name").join(names, "name").join(stats.select("term", "owner"), "term")
        .join(most, "term").groupBy("item", "owner")
        .agg(F.sort_array(F.collect_list("term")).alias("terms"), F.sum("most").alias("most")),
        "plan",
    )
    carried, bars = None, None
    for owner in range(OWNERS):
        carried = _visit(owner, plan, added, carried, bars, blocks, wanted, kinds)
        bars = stage_table(_bars(carried, wanted), "bars") if owner < OWNERS - 1 else None
    order = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    listed = carried.select("item", F.explode(F.arrays_zip("rows", "scores")).alias("x")).select(
        "item", F.col("x.rows").alias("row"), F.col("x.scores").alias("score")
    )
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select("item", "rank", "row", "score")


def _visit(owner, plan, added, carried, bars, blocks, wanted, kinds) -> DataFrame:
    """``block, item, rows, scores, best`` of the bundles behind an owner; best: the block's highest sums."""
    own = plan.groupBy("item").agg(
        F.flatten(F.collect_list(F.when(F.col("owner") == owner, F.col("terms")))).alias("terms"),
        F.coalesce(F.sum(F.when(F.col("owner") > owner, F.col("most"))), F.lit(0)).alias("later"),
        F.coalesce(F.sum(F.when(F.col("owner") >= owner, F.col("most"))), F.lit(0)).alias("ahead"),
    )
    if bars is None:
        own = own.withColumn("bar", F.lit(0).cast("long"))
    else:
        own = own.join(bars, "item", "left").withColumn("bar", F.coalesce("bar", F.lit(0).cast("long")))
    none = [F.lit(None).cast(f"array<{kinds[0]}>").alias("rows"), F.lit(None).cast("array<bigint>").alias("scores")]
    # the items visit every block
    bundles = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "block", "item", "terms", "later", "ahead", "bar", *none
    )
    if carried is not None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("terms", "array<int>"), ("later", "long"), ("ahead", "long"), ("bar", "long"))]
        bundles = bundles.unionByName(carried.where(F.size("rows") > 0).select("block", "item", *empty, "rows", "scores"))
    here = added.where(F.col("owner") == owner).select("block", "term", "row", "score")
    last = owner == OWNERS - 1
    schema = f"block int, item {kinds[1]}, rows array<{kinds[0]}>, scores array<bigint>, best array<bigint>"
    out = bundles.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(
        lambda left, right: _add(left, right, wanted, last), schema
    )
    return stage_table(out, f"owner{owner}")


def _bars(carried: DataFrame, wanted: int) -> DataFrame:
    """``item, bar``: the sum of its last wanted document so far, 0 if there are fewer."""
    each = carried.select("item", F.explode("best").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    top = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    full = F.count("*") == wanted
    return top.groupBy("item").agg(F.when(full, F.min("score")).otherwise(F.lit(0)).alias("bar"))


def _add(left: pa.Table, right: pa.Table, wanted: int, last: bool) -> pa.Table:
    """Contributions of an owner added to the bundles of a block."""
    left, right = left.combine_chunks(), right.combine_chunks()
    asks = left.filter(pc.is_valid(left.column("terms")))
    held = left.filter(pc.is_valid(left.column("rows")))
    kind = left.schema.field("rows").type.value_type
    rows, inverse = _numbers(
        [*(x.flatten() for x in held.column("rows").chunks), *right.column("row").chunks], kind
    )
    split = len(inverse) - right.num_rows
    before, own = inverse[:split], inverse[split:]
    ends = np.cumsum([0, *pc.list_value_length(held.column("rows")).to_pylist()])
    sums = np.concatenate([np.empty(0, I64), *(x.flatten().to_numpy() for x in held.column("scores").chunks)])
    place = {item: i for i, item in enumerate(held.column("item").to_pylist())}
    term = right.column("term").to_numpy()
    order = np.argsort(term, kind="stable")
    term, own, score = term[order], own[order], right.column("score").to_numpy()[order]
    total = np.zeros(len(rows), I64)
    out = []
    block = left.column("block")[0].as_py() if left.num_rows else None
    for ask in asks.select(["item", "terms", "later", "ahead", "bar"]).to_pylist():
        total[:] = 0
        at = place.get(ask["item"])
        some = before[ends[at] : ends[at + 1]] if at is not None else before[:0]
        total[some] = sums[ends[at] : ends[at + 1]] if at is not None else 0
        begins = np.searchsorted(term, ask["terms"])
        stops = np.searchsorted(term, ask["terms"], "right")
        for begin, stop in zip(begins.tolist(), stops.tolist()):
            total[own[begin:stop]] += score[begin:stop]
        if ask["ahead"] < ask["bar"]:  # what only this owner and later ones would find stays below the bar
            found = np.zeros(len(rows), bool)
            found[some] = True
            found = np.flatnonzero(found & (total > 0))
        else:
            found = np.flatnonzero(total)
        best = total[found]
        if len(best) > wanted:
            best = np.partition(best, len(best) - wanted)[-wanted:]
        bar = max(ask["bar"], int(best.min())) if len(best) == wanted else ask["bar"]
        kept = found[total[found] + ask["later"] >= bar]
        if last and len(kept) > wanted:  # the block's best; rows are numbered in their order
            kept = kept[np.lexsort((kept, -total[kept]))[:wanted]]
        if len(kept):
            out.append((ask["item"], kept, total[kept], best))
    lengths = [0, *np.cumsum([len(x[1]) for x in out])]
    flat = np.concatenate([np.empty(0, I64), *(x[1] for x in out)]).astype(I64)
    bests = [0, *np.cumsum([len(x[3]) for x in out])]
    return pa.table({
        "block": pa.array([block] * len(out), pa.int32()),
        "item": pa.array([x[0] for x in out], left.schema.field("item").type),
        "rows": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), rows.take(pa.array(flat))),
        "scores": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.empty(0, I64), *(x[2] for x in out)]))),
        "best": pa.ListArray.from_arrays(pa.array(bests, pa.int32()), pa.array(np.concatenate([np.empty(0, I64), *(x[3] for x in out)]))),
    })


def _numbers(parts: list[pa.Array], kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in ascending order, and the number of each value among them."""
    whole = pa.concat_arrays([pa.array([], kind), *parts])
    coded = whole.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), I64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def ranked_search(docs: DataFrame, items: DataFrame, wanted: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's best documents."""
    found = best_matches(docs, items, wanted)
    return found.select(
        key_column(found, "item").alias("item_id"), "rank", key_column(found, "row").alias("doc_id"), "score"
    )
