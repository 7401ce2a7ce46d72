"""The registered queries against DuckDB, and the pipeline against its parts."""

import oracle
import pytest

import corpus_pipeline
from tillwatch.llm.oracles import ORACLES
from tillwatch.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    names, rows = oracle.spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = oracle.duck_rows(oracle.connect(sf_dir), ORACLES[name])
    assert names == expected_names
    assert rows == expected


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{n}")
        rows = docs.select("doc_id").collect()
        assert {r["doc_id"] for r in rows} <= before
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert len(rows) <= sizes[-1]
        sizes.append(len(rows))
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_stages_on_odd_documents(spark, odd_docs, sf_dir):
    docs = odd_docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if n < 2:  # the classifiers are fitted on labels of other documents; see test_classifiers
            assert stage(spark, docs, sf_dir).columns == docs.columns
            continue
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0
