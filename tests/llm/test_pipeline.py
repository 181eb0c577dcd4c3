"""The pipeline's stages against what each must do to its input."""

import corpus_pipeline
from tessera.llm import decontaminate, quality, simhash

DIR = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    steps, now = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, DIR).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        steps.append(now)
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect() if r.doc_id is not None) for s in steps]
    for s in steps[:-1]:
        assert s.columns == docs.columns
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert ids[1] == sorted(r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1 and doc_id is not null").collect())
    one = simhash.drop_near_duplicates(steps[1], radius=corpus_pipeline.RADIUS, similarity=corpus_pipeline.SIMILARITY)
    assert ids[2] == sorted(r.doc_id for r in one.select("doc_id").collect() if r.doc_id is not None)
    leaks = {r.doc_id for r in decontaminate.contaminations(steps[2], spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert ids[3] == [d for d in ids[2] if d not in leaks]
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_input(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
