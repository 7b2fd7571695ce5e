from collections import Counter

import corpus_pipeline


def test_stages_one_after_the_other(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "secrets", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        came, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns and docs.count() <= came.count()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        asked = {r["doc_id"] for r in came.select("doc_id").collect()}
        if name == "quality":
            assert all(labels[i]["quality"] == 1 for i in ids & set(labels)) and sum(labels[i]["quality"] for i in asked & set(labels)) - sum(labels[i]["quality"] for i in ids & set(labels)) <= 3
        elif name == "simhash":
            texts = Counter(r["text"] for r in docs.select("text").collect())
            assert max(texts.values()) == 1
        elif name in ("secrets", "packing"):
            assert ids == asked
        if name == "secrets":
            assert docs.filter("text rlike '[0-9a-f]{16,}'").count() == 0
    assert before > 0
