"""The pipeline's stages: columns kept, decisions taken, edge rows and empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from rarelane.llm.queries import ORACLES, QUERIES
from rarelane.session import stage_table

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES and set(ORACLES) == {"op8_url_filter", "op13_ranked_search"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "benchmark", "packing"]


def test_stages_of_a_folder(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage_table(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert out.columns == columns and out.count() <= before
            assert out.select("doc_id").distinct().count() == out.count()
            before = out.count()
        docs = out
    assert docs.agg({"length": "sum"}).first()[0] == docs.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_edge_rows(spark, edge_docs, no_docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, no_docs if empty else edge_docs, FOLDER)
        assert name == "packing" or docs.columns == edge_docs.columns
        assert (docs.count() == 0) == empty
