import pytest

import corpus_pipeline
from pagewright.llm import queries
from tests.oracle import DATA, connection, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], connection())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, DATA), name, keep=True)
        assert out.columns == docs.columns
        if name in ("language", "personal_data"):
            assert out.count() == docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.where("not round_trip").count() == 0 and 0 < last.count() < before
