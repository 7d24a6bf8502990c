"""The stages, each on what its predecessor kept."""

import collections

import corpus_pipeline


def test_stages_keep_the_columns_and_run_gives_packed_pieces(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[3] > 0
    loads = collections.Counter()
    for r in docs.collect():
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 2048
