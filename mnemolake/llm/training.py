"""A bounded, repeatable sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import broadcast_if_small, discard, materialise, whole_text

_TOP = 1 << 32
#: UTF-8 bytes of all examples together at most, unless the first alone has more.
SAMPLE_BYTES = 64 << 20


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """About `rows` labelled texts of at most most_bytes together, chosen by a hash of doc_id among the label rows that `keep` admits.

    labels is counted first; the share of hashes that is let through follows from the count, so the sample has no
    preference and its size doesn't grow. Of the chosen those of the smallest hashes stay, as many as the bytes allow.
    Rows without a label are no examples; repeated label rows count once; of documents of one doc_id the smallest text is
    the example, however often it repeats; a null doc_id matches nothing.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(keep & F.col("y").isin(0, 1)).distinct()
    total = usable.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(_TOP))
    chosen = usable.withColumn("draw", draw).where(F.col("draw") < int(_TOP * min(1.0, rows / max(1, total))) + 1)
    chosen = materialise(chosen.select(F.col("doc_id").alias("id"), "y", "draw"), "sample")
    held = documents.select("doc_id", whole_text().alias("text")).join(broadcast_if_small(chosen.select("id").distinct()), F.col("doc_id") == F.col("id"), "left_semi")
    held = held.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = materialise(held.join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y", "draw"), "examples")
    last, size = -1, 0
    for at, n in sorted(tuple(r) for r in found.select("draw", F.octet_length("text")).collect()):
        size += n
        if size > most_bytes and last >= 0:
            break
        last = at
    examples = found.where(F.col("draw") <= last).collect()
    discard(chosen, found)
    return [(r.text, r.y) for r in sorted(examples, key=lambda r: (str(r.doc_id), r.text, r.y))]
