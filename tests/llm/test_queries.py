"""The registered queries: SQL where there is one, held-out accuracy, recall and the pipeline."""

import pytest

from textloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(name, spark):
    assert queries.queries()[name](spark, SMALL).count() > 0


def test_near_duplicates_against_brute_force(spark):
    from textloom.llm import jaccard_join
    from textloom.llm.common import table

    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert rows == jaccard_join.brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.saved(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        assert 0.6 * left < docs.count() <= left, name
        left = docs.count()
    packed = pipeline.saved(pipeline.STAGES[-1][1](spark, docs, SMALL))
    assert packed.select("doc_id").distinct().count() == left


def test_pipeline_edges(spark):
    """Nulls in any column, no rows, repeated rows and extra columns pass through every stage."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "a text without an id at all", None, None, None), (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "twice the same row here", "en", "src1", 23), (9003, "twice the same row here", "en", "src1", 23)], docs.schema)
    now = docs.unionByName(odd).selectExpr("*", "1 as score", "'x' as key", "'y' as found")
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.saved(stage(spark, now, SMALL))
        ids = [r.doc_id for r in now.collect()]
        assert {None, 9001, 9002, 9003} <= set(ids), name
    assert ids.count(9003) == 1
    assert pipeline.saved(pipeline.STAGES[-1][1](spark, now, SMALL)).filter("doc_id = 9001").count() == 1
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        none = pipeline.saved(stage(spark, none, SMALL))
    assert none.count() == 0
