"""Ranked search against a plain sum over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from rarelane.llm import ranked
from rarelane.llm.queries import ORACLES, QUERIES
from rarelane.llm.ranked import ranked_search, text_terms
from tests.llm.conftest import prose
from tests.oracle import compare, connect

ITEMS = T.StructType([T.StructField(n, t) for n, t in (
    ("item_id", T.LongType()), ("text", T.StringType()), ("row", T.StringType()), ("term", T.StringType()))])


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_search(docs, items, wanted=10):
    terms = [plain_terms(t) for _, t in docs]
    n, size = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    tfs = [Counter(t) for t in terms]
    out = []
    for item, text in items:
        scores = []
        for (key, _), own, tf in zip(docs, terms, tfs):
            score = 0
            for w in set(plain_terms(text)) & tf.keys():
                m = 100 - 90 + 90 * len(own) * n // size
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0))
        out += [(item, i + 1, k if some else None, -s) for i, (s, some, k) in enumerate(sorted(scores)[:wanted])]
    return sorted(out, key=str)


def got(spark, docs, items, wanted=10):
    asked = spark.createDataFrame([(k, t, "r", "t") for k, t in items], ITEMS)
    return sorted((tuple(r) for r in ranked_search(docs, asked, wanted).collect()), key=str)


def test_terms_are_maximal_runs():
    texts = ["", None, "A-b_c9 ÉcOle\x7fx\x1c日本 ~", "--", "zZ", "a\x80b"]
    terms, counts = text_terms(pa.array([t or "" for t in texts], pa.large_string()))
    assert terms.to_pylist() == [w for t in texts for w in plain_terms(t)]
    assert counts.tolist() == [len(plain_terms(t)) for t in texts]


@pytest.mark.parametrize("block, terms, wanted", [(8192, 200_000, 10), (16, 50, 3), (40, 7, 1)])
def test_ranks_equal_a_plain_sum(spark, make_docs, monkeypatch, block, terms, wanted):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "TERMS", terms)
    r = random.Random(block)
    docs = [(k, prose(k % 70, 3 + k % 50) + (" rare%d" % (k % 40)) * (k % 3)) for k in range(250)]
    items = [(i, prose(1000 + i, 12) + f" rare{i} the the") for i in range(20)] + [(99, docs[5][1]), (98, "the"), (97, "")]
    r.shuffle(docs)
    assert got(spark, make_docs(docs).repartition(3), items, wanted) == plain_search(docs, items, wanted)


def test_edge_rows(spark, edge_docs, edge_texts, no_docs):
    long = "x" * 500
    items = [(None, "the one"), (None, None), (3, "one two three"), (3, long), (4, ""), (5, "日本 don z"), (6, "nowhere")]
    assert got(spark, edge_docs, items) == plain_search(edge_texts, items)
    assert got(spark, no_docs, items) == [] and got(spark, edge_docs, []) == []


def test_names_of_long_terms(spark, make_docs):
    docs = [(1, "x" * 500), (2, "x" * 501 + " b"), (3, "b c"), (4, "y " * 40 + "x" * 500), (5, None), (6, "c")]
    items = [(1, "X" * 500 + " b"), (2, "x" * 501)]
    assert got(spark, make_docs(docs), items) == plain_search(docs, items)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op13_ranked_search"
    assert compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name]) is None
