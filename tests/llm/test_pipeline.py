"""The stages in order, each on what the one before kept."""

import corpus_pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(before.columns) < set(out.columns)
    assert out.where("not round_trip").count() == 0
    assert 0 < out.count() <= before.count()
    assert out.select("doc_id").distinct().count() == out.count()
    assert out.join(before, "doc_id", "left_anti").count() == 0
