import os

import pytest

import corpus_pipeline
from marginalia.llm.common import stored

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    schema = docs.schema.simpleString()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.collect()}
        docs = stored(stage(spark, docs, SMALL), name)
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        if at + 1 < len(corpus_pipeline.STAGES):
            assert docs.schema.simpleString() == schema
        if name == "quality_classifier":
            assert not [d for d in after if labels.get(d) == 0]
            assert len([d for d in before - after if labels.get(d) == 1]) <= 2
        if name == "line_dedup":
            assert after == before and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "benchmark_decontamination":
            assert not [r for r in docs.collect() if any(i in r.text for i in items)]
    assert docs.count() > 50 and all(r.round_trip for r in docs.collect())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_with_odd_rows(spark, documents, at):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns with the names of helpers."""
    name, stage = corpus_pipeline.STAGES[at]
    words = "Many readers found that the small library near the river was open on most days of the week. "
    rows = [(1, None), (2, ""), (3, words * 3000), (4, words), (4, words), (None, "one word"), (9223372036854775807, "another text of five words")]
    found = stage(spark, documents(rows), SMALL)
    assert stage(spark, documents([]), SMALL).count() == 0
    if at + 1 < len(corpus_pipeline.STAGES):
        assert found.columns == list(corpus_pipeline.COLUMNS)
    ids = sorted((r.doc_id or 0 for r in found.collect()))
    if name == "quality_classifier":
        assert set(ids) <= {d or 0 for d, _ in rows}
    elif name == "ngram_jaccard_join":
        # equal words in another number make other shingle sets only at the seams
        assert ids == [0, 1, 2, 3, 4, 4, 9223372036854775807] or ids == [0, 1, 2, 3, 9223372036854775807]
    else:
        assert ids == sorted(d or 0 for d, _ in rows)
