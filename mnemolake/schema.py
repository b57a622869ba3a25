"""The data model: memory rows, events, bundle entries and audit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, MODEL = 64, "mnemolake-hash-v1"
#: Column, type, default (a value, or None where null is the default).
MEMORY = (
    ("id", "string", None), ("identifier", "string", None), ("fact_text", "string", ""), ("embedding", "array<float>", None), ("embedding_dim", "int", DIM), ("embedding_model", "string", ""),
    ("source", "string", ""), ("importance", "double", 0.5), ("metadata_json", "string", "{}"), ("content_hash", "string", ""), ("ttl_seconds", "long", None), ("created_at", "string", None),
    ("namespace", "string", ""), ("tier", "string", "hot"), ("memory_type", "string", "fact"), ("source_uri", "string", ""), ("source_format", "string", ""), ("source_checksum", "string", ""),
    ("byte_offset", "long", None), ("byte_length", "long", None), ("updated_at", "string", None), ("snapshot_id", "string", ""), ("promotion_state", "string", "HOT"), ("promotion_candidate", "int", 0),
    ("parent_memory", "string", ""), ("related_memories", "string", "[]"), ("tags", "string", "[]"), ("schema_version", "int", 1), ("fact_summary", "string", None), ("provenance_json", "string", None),
)
EVENT = (("seq", "long", None), ("event_id", "string", None), ("memory_id", "string", None), ("namespace", "string", ""), ("event_type", "string", None), ("occurred_at", "string", None), ("payload_json", "string", "{}"))
BUNDLE = (("path", "string", None), ("primary_file", "string", ""), ("metadata_json", "string", "{}"), ("attachment_count", "int", 0), ("checksum", "string", ""), ("modified_time", "string", None), ("size_hint", "long", 0), ("warning_count", "int", 0), ("discovered_at", "string", None))
HISTORY = (("id", "string", None), ("memory_id", "string", None), ("old_memory", "string", None), ("new_memory", "string", None), ("event", "string", None), ("created_at", "string", None), ("updated_at", "string", None), ("is_deleted", "int", 0), ("actor_id", "string", None), ("role", "string", None))


def ddl(columns: tuple) -> str:
    return ", ".join(f"{name} {kind}" for name, kind, _ in columns)


def conform(df: DataFrame, columns: tuple = MEMORY) -> DataFrame:
    """Projects to the model's columns: absent ones get their default, nulls of a column with a default too."""
    have = set(df.columns)

    def one(name: str, kind: str, default):
        column = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return (column if default is None else F.coalesce(column, F.lit(default).cast(kind))).alias(name)

    return df.select(*(one(*c) for c in columns))
