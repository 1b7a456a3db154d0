"""The stages in a row, on the small table, against each operator's own decisions."""
import corpus_pipeline
from lakeloom.llm.common import cut, prepare
from lakeloom.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    prepare(spark)
    docs = load(spark, SF, "documents")
    before, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == before and 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_entry_has_all():
    import __spark_entry__ as e
    names = list(e.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{k}_") for x in names) for k in range(1, 11))
