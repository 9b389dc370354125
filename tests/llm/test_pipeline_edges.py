"""Every stage on nulls, empty and long texts, repeated rows, an empty table, and columns named like results."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    some = docs.first()
    long = " ".join(["wort und haus"] * 30_000)
    extra = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "123 --", "de", "s", 6), (9004, long, "de", "s", len(long)), (None, some.text, "en", "s", 1), (some.doc_id, some.text, some.lang, some.source, some.n_chars)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    return rows.withColumns({"score": F.lit("x"), "n_hit": F.lit("y"), "component_id": F.lit("z"), "n_removed": F.lit("v"), "n_tokens": F.lit("w")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SF_DIR)
    rows = out.select("doc_id", "text").collect()
    assert set(odd.columns) <= set(out.columns)
    ids = [r.doc_id for r in rows]
    if name == "language_id":
        assert not {9001, 9002, 9003} & set(ids) and 9004 in ids
    elif name == "bpe":
        assert len(rows) == odd.count()
    else:
        assert {9001, 9002} <= set(ids)
    if name == "near_dedup":
        assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and None in ids
    assert stage(spark, odd.limit(0), SF_DIR).collect() == []
