"""The pipeline's stages, each against what it must keep."""

from assayline.llm import jaccard_join, line_dedup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        sizes.append((name, before.count(), after.count()))
        if name != "pieces":
            assert after.columns == docs.columns
        if name == "jaccard_join":
            assert jaccard_join.components(after).where("component_id <> doc_id").count() == 0
        if name == "line_dedup":
            assert line_dedup.removed(after).where(F.size("removed") > 0).count() == 0
        before = after
    assert all(n > 0 for *_, n in sizes)
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1][2]
