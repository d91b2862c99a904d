import corpus_pipeline
from lodestar.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == docs.count() <= left
            left = docs.count()
    assert docs.select("doc_id").distinct().count() == left > 0


def test_near_duplicates_of_the_kept_rows_are_gone(spark):
    from .test_jaccard import brute

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    want = {c for _, n, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80) if n}
    assert {i for i, _ in kept} == want


def test_run_and_registry(spark):
    import __spark_entry__

    assert corpus_pipeline.run(spark, SMALL).agg({"length": "max"}).first()[0] <= 4096
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
