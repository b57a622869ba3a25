"""Every operator over empty tables, nulls in all columns, ties, repeated rows and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("mnemolake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from mnemolake.llm import centroids, chat, decontaminate, html, licenses, media, mixing, near_duplicates, pii, quality, resampling, topk, toxicity  # noqa: E402

CLASHING = "size source_size target taken block score predicted held_out p c m n k a b s key sketches component low valid segments formatted turns digest license notices known y hits kept_key kept_id"
ROWS = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, None, "b", None), (3, "one two three four five six", "en", "b", 27), (3, "one two three four five seven", "en", "a", 29)]),
    "labels": ("doc_id long, quality int, toxic int", [(None, 1, 1), (1, None, None), (2, 0, 0), (3, 1, None), (3, 1, 0), (9, 1, 1)]),
    "benchmark": ("item_id long, text string", [(None, None), (1, None), (2, ""), (2, "four five"), (2, "four five")]),
    "pages": ("page_id long, url string, html string", [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>a text that stays</p>")]),
    "embeddings": ("vec_id long, embedding array<float>, label int", [(None, [0.5, 0.25], None), (1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.0, -1.0], 2)]),
    "conversations": ("conv_id long, turn long, role string, text string", [(None, None, None, None), (None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "x"), (2, 1, None, "</turn>")]),
}


def hit_words(t):
    return decontaminate.contamination(t["documents"], t["benchmark"])


OPERATORS = {
    "media": ("documents", lambda t: media.media_features(t["documents"])),
    "mixing": ("documents", lambda t: mixing.mix(t["documents"])),
    "contamination": ("documents", hit_words),
    "toxicity": ("documents", lambda t: toxicity.score_toxicity(t["documents"], t["labels"])),
    "pii": ("documents", lambda t: pii.scan_personal_data(t["documents"])),
    "near_duplicates": ("documents", lambda t: near_duplicates.near_duplicate_classes(t["documents"])),
    "quality": ("documents", lambda t: quality.score_quality(t["documents"], t["labels"])),
    "licenses": ("documents", lambda t: licenses.scan_licenses(t["documents"])),
    "html": ("pages", lambda t: html.extract_pages(t["pages"])),
    "resampling": ("documents", lambda t: resampling.resample(t["documents"], t["benchmark"])),
    "clusters": ("embeddings", lambda t: centroids.cluster(t["embeddings"], dims=2)),
    "top_k": ("embeddings", lambda t: topk.top_k(t["embeddings"], F.lit(True), k=1)),
    "chat": ("conversations", lambda t: chat.conversation_digests(t["conversations"])),
}


@pytest.fixture
def tables(spark):
    def make(empty):
        out = {}
        for name, (schema, rows) in ROWS.items():
            df = spark.createDataFrame([] if empty else rows, schema)
            own = {c.lower() for c in df.columns}
            out[name] = df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHING.split() if c not in own))
        return out

    return make


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_at_the_edges(tables, name):
    of, operator = OPERATORS[name]
    assert operator(tables(empty=True)).collect() == []
    rows = ROWS[of][1]
    got = operator(tables(empty=False)).collect()
    want = len({r[0] for r in rows}) if name == "chat" else len(rows)
    assert len(got) == want and sorted(str(r[0]) for r in got) == sorted(str(x) for x in ({r[0] for r in rows} if name == "chat" else [r[0] for r in rows]))


@pytest.mark.parametrize("empty", [True, False])
def test_stages_at_the_edges(spark, tables, tmp_path, empty):
    made = tables(empty)
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = made["documents"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) != empty
