"""Shards: the law of rows, the same order as a plain external shuffle, edge rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rarelane.llm.queries import QUERIES
from rarelane.llm.shards import read_shards, write_shards
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"


def shard_rows(spark, docs, folder, shards, **settings):
    write_shards(docs, folder, shards, **settings)
    return read_shards(spark, folder, docs.schema).select("shard", "slot", "row.*").collect()


def assert_law(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == n
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_order(keys, sizes, seed, bucket_bytes):
    """Scatter by hash, order each bucket by key, shuffle it, and put the buckets in a row."""
    buckets = -(-sum(sizes) // bucket_bytes)
    start = xxh64_intdigest((seed).to_bytes(4, "little"), 42)  # the seed is hashed first, as an int
    held = defaultdict(list)
    for k in keys:
        h = xxh64_intdigest(k.to_bytes(8, "little", signed=True), start)
        held[int(np.uint64(h).view(np.int64)) % buckets].append(k)
    out = []
    for b in sorted(held):
        order = np.arange(len(held[b]))
        np.random.Generator(np.random.Philox(key=[seed, b])).shuffle(order)
        out += [sorted(held[b])[i] for i in order]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_order_is_that_of_a_plain_external_shuffle(spark, make_docs, tmp_path, parts):
    texts = [(k * 7 - 300, prose(k, 5 + k % 40)) for k in range(200)]
    docs = make_docs(texts).repartition(parts).select("doc_id", "text")
    rows = shard_rows(spark, docs, str(tmp_path / "s"), 7, seed=3, bucket_bytes=4000)
    assert_law(rows, 200, 7)
    sizes = [8 + 8 + len(t.encode()) for _, t in texts]
    want = plain_order([k for k, _ in texts], sizes, 3, 4000)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == want
    assert {r.doc_id: r.text for r in rows} == dict(texts)


def test_edge_rows(spark, edge_docs, edge_texts, no_docs, tmp_path):
    clashing = edge_docs.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "base": F.lit("b"), "bucket": F.lit(1)})
    write_shards(clashing, str(tmp_path / "a"), 4, bucket_bytes=50_000)
    found = read_shards(spark, str(tmp_path / "a"), clashing.schema)
    rows = found.select("shard", "slot", "row.doc_id", "row.text", F.col("row.shard").alias("x")).collect()
    assert_law(rows, len(edge_texts), 4)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(edge_texts) and {r.x for r in rows} == {"x"}
    assert shard_rows(spark, no_docs, str(tmp_path / "b"), 3) == []
    few = shard_rows(spark, edge_docs.where("doc_id = 7"), str(tmp_path / "c"), 3)
    assert_law(few, 1, 3)
    with pytest.raises(ValueError):
        write_shards(edge_docs, str(tmp_path / "d"), 0)


def test_copies_are_spread(spark, make_docs, tmp_path):
    docs = make_docs([(None, "same")] * 300 + [(5, "same")] * 300)
    write_shards(docs, str(tmp_path / "a"), 6, bucket_bytes=10_000)
    rows = read_shards(spark, str(tmp_path / "a"), docs.schema).select("shard", "slot", "row.doc_id").collect()
    assert_law(rows, 600, 6)
    own = Counter(r.shard for r in rows if r.doc_id is None)
    assert min(own.values()) > 25 and max(own.values()) < 75


def test_query(spark):
    rows = QUERIES["op11_shards"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert_law(rows, len(texts), 24)
    for r in rows:
        data = texts.pop(r.doc_id).encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    assert not texts
