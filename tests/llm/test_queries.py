"""The registered queries of the subpackage, against SQL where there is some, and the pipeline."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from wayfarer.llm import queries


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, agrees, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    if name in queries.ORACLE_SQL:
        agrees(df, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_langid_held_out_accuracy(spark):
    found = queries.QUERIES["op5_langid"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR)
    assert set(docs.columns) < set(out.columns)
    assert 0.5 * docs.count() < out.count() < docs.count()
    assert out.select("doc_id").distinct().count() == out.count()
