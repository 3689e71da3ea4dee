import corpus_pipeline
from tidemark.llm.common import table

D = "/root/testdata/sf0.01"


def test_stages_filter_in_order(spark):
    docs = table(spark, D, "documents")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, D), name)
        assert docs.columns == columns
        now = docs.count()
        assert 0.5 * left < now < left, name
        left = now
    done = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert done.count() == left and done.where("not round_trip").count() == 0


def test_empty_documents(spark):
    docs = table(spark, D, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_awkward_documents(spark, awkward):
    """Every stage alone: nothing crashes, own columns stay, no row comes twice, and the last gives a row for each."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, D)
        assert out.columns == awkward.columns and out.count() <= awkward.count()
        assert out.exceptAll(awkward).count() == 0
    done = corpus_pipeline.STAGES[-1][1](spark, awkward, D).collect()
    assert len(done) == awkward.count() and all(r.round_trip in (True, None) for r in done)


def test_awkward_documents_chained(spark, awkward):
    """Through the stages that don't learn: of equal sets one row stays, with or without an id, and blanks all stay."""
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[2:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, D), name)
        assert docs.columns == awkward.columns
    left = [1, 2, 3, 4, 6, 7, 8, 9, None]
    assert sorted(r.doc_id or 0 for r in docs.collect()) == sorted(i or 0 for i in left)
    done = corpus_pipeline.STAGES[4][1](spark, docs, D).collect()
    assert len(done) == len(left) and all(r.round_trip in (True, None) for r in done)
