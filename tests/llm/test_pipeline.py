"""The stages keep their contracts, and the whole run is what the stages give one after another."""


import corpus_pipeline
from foliant.llm import decontaminate, near_dedup
from foliant.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert docs.count() <= left
        left = docs.count()
    report = decontaminate.report(docs, table(spark, SF, "benchmark"))
    assert report.where("n_hit > 30").isEmpty()
    assert near_dedup.labelled(table(spark, SF, "documents")).where("not kept").count() > 0
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == left and out.where("NOT round_trip").isEmpty()
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
