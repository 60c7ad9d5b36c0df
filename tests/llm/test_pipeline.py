"""The pipeline's stages on a small table: each keeps what it should of the one before."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark):
    from lexmill.session import ship

    ship(spark)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            docs = docs.checkpoint()
            assert docs.columns == columns, name
            counts.append(docs.count())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "mixing sources", "best-fit packing"]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert key(docs) == key(corpus_pipeline.run(spark, sf))
