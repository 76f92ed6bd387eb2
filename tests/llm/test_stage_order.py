"""Token shards of the pipeline in training order."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, frame


def test_shards_keep_the_order_of_training(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = frame(spark, documents()).orderBy(F.xxhash64("doc_id", "text"))
    want = [r.doc_id for r in docs.collect()]
    docs.write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.write_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").orderBy("start").collect()
    assert [r.doc_id for r in got] == want and want != sorted(want, key=lambda x: x or 0)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
