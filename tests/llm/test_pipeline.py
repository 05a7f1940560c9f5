"""The stages by their contract, and against plain checks on a small table."""

import corpus_pipeline
from folioflow.llm import queries


def test_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns, rows = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        docs = out.cache()
        if name in ("toxicity", "near_dedup"):
            assert 0.5 * rows < docs.count() <= rows and docs.select("doc_id").distinct().count() == docs.count()
            rows = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).filter("not round_trip").count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
