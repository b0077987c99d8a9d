import corpus_pipeline
from weftline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] >= kept[3] > 0.5 * kept[0]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == kept[3]


def test_nothing(spark, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, SF).count() == 0
