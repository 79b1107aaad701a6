"""Queries with SQL against it, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from lamina.llm.load import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    n, problem = compare(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert problem is None and n > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    from lamina.llm.common import keep

    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, FOLDER), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0 and before
