"""The whole pipeline on odd documents, with clashing column names, and on none."""

import pytest

import corpus_pipeline
from heliograph.llm.shared import table

from .conftest import ROWS


@pytest.fixture()
def folder(spark, tmp_path):
    """Labels of the smallest tables, so that the classifier has something to learn, and documents of our own beside theirs."""
    table(spark, "/root/testdata/sf0.001", "labels").write.parquet(str(tmp_path / "labels.parquet"))

    def put(docs):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return put


def test_odd_and_no_documents(spark, folder):
    known = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    rows = [(1_000_000 + k if r[0] is not None else None, r[1], None, r[2], None) for k, r in enumerate(ROWS)]
    odd = known.unionByName(spark.createDataFrame(rows, known.schema))
    clash = odd.selectExpr("*", "doc_id AS fp", "text AS t", "1 AS size", "'x' AS row", "0.5 AS score")
    path = folder(clash)
    docs = table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert docs.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0 and packed.count()
    none = folder(clash.limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0
