import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] >= counts[1] == counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert docs.where("not round_trip or not parity").count() == 0
    assert pipeline.run(spark, SF).count() == counts[5]
