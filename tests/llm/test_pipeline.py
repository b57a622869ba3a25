import pytest

pytest.importorskip("mnemolake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from mnemolake.llm import mixing, pii, toxicity  # noqa: E402
from mnemolake.llm.common import table  # noqa: E402
from tests.llm.test_operators import brute_classes, brute_contamination  # noqa: E402
from tests.oracle import DATA  # noqa: E402


def test_pipeline_equals_stage_by_stage_brute_force(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = table(spark, DATA, "documents")
    model = toxicity.train(docs, table(spark, DATA, "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if model.score(r.text or "") < 0.5]
    rows = [r for r in rows if str(r[0]) in {c for _, c in brute_classes(rows)}]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    rows = [r for r in rows if not brute_contamination(r[1], items)[-1]]
    rows = [(i, pii.mask(t, pii.find_all(t)[1]), s) for i, t, s in rows]
    assert got.keys() == {r[0] for r in rows}
    want = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(got[r.doc_id] == r for r in want)


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, DATA, "documents").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
