from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

#: Further columns whose names operators use for their own.
ODD = ["print", "score", "start", "component_id", "key", "row", "u", "w", "units", "word", "rest"]
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ODD]
)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice(["the", "an", "er", "in", "ti", "on", "es", "ä", "re"]) for _ in range(r.randint(1, 4)))
        out.append(w + (r.choice([".", ".\n", ",", ""]) if i % 7 == 6 else ""))
    return " ".join(out)


def rows_of(texts) -> list[tuple]:
    """(doc_id, text) pairs as rows of documents with the odd columns."""
    return [(k, t, "en", "s", len(t or ""), *[f"{n}-{i}" for n in ODD]) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts):
        return spark.createDataFrame(rows_of(texts), DOCS)

    return make


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows and keys."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (None, None), (None, base), (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base),
        (6, " ".join(near)), (7, prose(2, 30_000)), (8, "one"), (9, "one two three"), (10, prose(3, 300)),
        (11, "don't 12 3,4  x\n\n\ny z 日本 \U0001f600 <|endoftext|>"),
        (-12, prose(4, 80) + " " + base), (13, "the " * 500),
    ]


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_texts):
    return make_docs(edge_texts).repartition(3)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
