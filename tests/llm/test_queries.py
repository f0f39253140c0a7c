"""The registered queries on whole small tables: SQL where there is some, else held-out accuracy and whole row counts."""

import os

import pytest

import corpus_pipeline
from loomstone.llm import queries, shared

from ..oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_its_sql(spark, name):
    same(spark, connection(SF), queries.QUERIES[name], queries.SQL[name], SF)


def test_lm_beats_add_one_words_on_held_out_texts(spark):
    got = queries.op1_lm_scoring(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    score, base = got.filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = queries.op2_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").selectExpr("avg(abs(predicted - toxic))", "sum(if(toxic = 0, predicted, 0))").first()
    assert r[0] < 0.1 and r[1] == 0


def test_pipeline_stages_shrink_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    n, columns = docs.count(), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).checkpoint()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() <= n
    for empty in (spark.read.parquet(f"{SF}/documents.parquet").limit(0),):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, SF).count() == 0


def test_pipeline_with_empty_side_tables(spark, tmp_path):
    """Without labels nothing is toxic, without items nothing leaks; only copies and repeated lines go."""
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df if name == "documents" else df.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.without_leaks(spark, docs, str(tmp_path)).count() == docs.count()
    (docs.limit(1).select("doc_id").selectExpr("doc_id", "1 as toxic", "1 as quality")).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "copy"] and got.count() > 0
    assert set(shared.made(spark)) <= {p for p in shared.made(spark) if os.path.exists(p.removeprefix("file:"))}
