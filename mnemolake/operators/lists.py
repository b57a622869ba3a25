"""Filters, lists, counts, profiles and the small adapter pipelines over memory rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.exprs import agent_truncate, resolve_uri, ttl_live

SCAN = ("id", "identifier", "fact_text", "source", "importance", "metadata_json", "content_hash", "ttl_seconds", "created_at")


def all_rows(memories: DataFrame, include_embedding: bool = False) -> DataFrame:
    return memories if include_embedding else memories.drop("embedding")


def by_id(memories: DataFrame, memory_id: str) -> DataFrame:
    return memories.where(F.col("id") == memory_id)


def exists(memories: DataFrame, content_hash: str) -> bool:
    return bool(memories.where(F.col("content_hash") == content_hash).limit(1).count())


def content_hashes(memories: DataFrame) -> DataFrame:
    return memories.select("content_hash").where("content_hash != ''").distinct()


def by_identifier(memories: DataFrame, identifier: str, now: int, ascending: bool = True, limit: int = 100) -> DataFrame:
    """Live rows in order of time; archived rows are shown."""
    rows = memories.where((F.col("identifier") == identifier) & ttl_live(now))
    order = (F.asc if ascending else F.desc)
    return rows.orderBy(order("created_at"), order("id")).limit(limit)


def candidates(memories: DataFrame, namespace: str | None = None, state: str | None = None) -> DataFrame:
    rows = memories.where("promotion_candidate = 1")
    rows = rows if namespace is None else rows.where(F.col("namespace") == namespace)
    return rows if state is None else rows.where(F.col("promotion_state") == state)


def by_state(memories: DataFrame, state: str, namespace: str | None = None) -> DataFrame:
    rows = memories.where(F.col("promotion_state") == state)
    return rows if namespace is None else rows.where(F.col("namespace") == namespace)


def file_backed(memories: DataFrame) -> DataFrame:
    return memories.where("memory_type = 'file'")


def counts_by_type(memories: DataFrame) -> DataFrame:
    return memories.groupBy("memory_type").agg(F.count("*").alias("n"))


def files_missing(memories: DataFrame, listing: DataFrame, base: str) -> DataFrame:
    """File rows with whether their file is in a listing (path, length)."""
    rows = file_backed(memories).select("id", resolve_uri(F.col("source_uri"), base).alias("uri"), "byte_offset", "byte_length")
    return rows.join(listing.select(F.col("path").alias("uri"), F.col("length").alias("file_bytes")), "uri", "left").withColumn("missing", F.col("file_bytes").isNull())


def hydrate_order(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (pos, id) with their rows, in the order asked; unknown ids stay with nulls."""
    return ids.join(memories, "id", "left").orderBy("pos")


def profile(memories: DataFrame, kind: str) -> DataFrame:
    """Metadata-only profiles. compact has no text; agent has a summary or a bounded text, no file is opened."""
    base = ["id", "identifier", "memory_type", "importance", "created_at", "source_uri"]
    if kind == "compact":
        return memories.select(*base, F.char_length("fact_text").cast("long").alias("text_chars"))
    if kind == "agent":
        inline = agent_truncate(F.col("fact_text"))
        content = F.when(F.col("memory_type") == "file", F.coalesce(F.col("fact_summary"), F.lit(""))).otherwise(inline)
        return memories.select(*base, content.alias("content"), (F.char_length("fact_text") > 4096).alias("truncated"))
    raise ValueError(f"unknown profile: {kind}")


#: Bytes of joined values that travel as one row.
_CHUNK = 1 << 20


def ordered_hash(df: DataFrame, column: str) -> DataFrame:
    """One row: the SHA-256 of all values in order, joined without a separator; of nothing where there are none.

    The sort is over ranges, in all tasks; each joins its values to chunks. A digest of one string can't be split, so
    one task reads the chunks, but it holds no more than one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, held = 0, 0, []
        chunk = lambda: pa.RecordBatch.from_arrays([part.slice(0, 1), pa.array([n], pa.int64()), pa.array(["".join(held)])], names=["part", "n", "chunk"])
        for batch in batches:
            part = batch.column(0)
            for value in batch.column(1):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= _CHUNK:
                    yield chunk()
                    n, size, held = n + 1, 0, []
        if held:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for batch in batches:
            for value in batch.column(0):
                h.update(value.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["digest"])

    ranged = df.where(F.col(column) != "").select(column).orderBy(column).select(F.spark_partition_id().alias("part"), column)
    chunks = ranged.mapInArrow(join, "part int, n long, chunk string").repartition(1).sortWithinPartitions("part", "n").select("chunk")
    return chunks.mapInArrow(digest, "digest string").agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"))


#: Fixed value: words that mark a lasting fact.
CUES = r"(?i)\b(actually|remember that|from now on|don'?t|always|never|prefer)\b"


def durable_facts(conversations: DataFrame, cues: str = CUES, last: int = 6, chars: int = 1000) -> DataFrame:
    """Messages with a cue word among the last few of each conversation."""
    rows = conversations.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    return rows.where(F.col("text").rlike(cues)).select("conv_id", "turn", F.substring("text", 1, chars).alias("fact"), F.lit(0.6).alias("importance"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """A memory row for each user or assistant message."""
    said = conversations.where(F.col("role").isin("user", "assistant"))
    user = F.col("role") == "user"
    return said.select("conv_id", "turn", F.concat(F.when(user, "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit(""))).alias("fact_text"), F.when(user, 0.4).otherwise(0.3).alias("importance"), F.lit("turn").alias("source"))


def mirrored_importance() -> Column:
    return F.when(F.col("target") == "user", 0.9).when(F.col("target") == "memory", 0.8).otherwise(0.5)


def mirrored_writes(writes: DataFrame) -> DataFrame:
    """Writes (action, target, ...) made elsewhere with their importance; a removal expires after a second, as nothing is deleted."""
    return writes.withColumn("importance", mirrored_importance()).withColumn("ttl_seconds", F.when(F.col("action") == "remove", F.lit(1).cast("long")))
