"""Content of memories: inline, or read from the file that a row refers to, verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.sources.storage import read_references


def hydrate(memories: DataFrame, base: str | None = None, verify: bool = True) -> DataFrame:
    """(id, content, verified, reason): inline rows have their text's bytes, unverified."""
    file = F.col("memory_type").eqNullSafe("file")
    inline = memories.where(~file).select("id", F.encode(F.coalesce("fact_text", F.lit("")), "UTF-8").alias("content"), F.lit(False).alias("verified"), F.lit(None).cast("string").alias("reason"))
    return inline.unionByName(read_references(memories.where(file), base, verify))


def hydrate_many(memories: DataFrame, ids: DataFrame, base: str | None = None, verify: bool = True) -> DataFrame:
    """ids (pos, id) in order with content; an unknown id has the reason not_found."""
    asked = memories.join(ids.select("id").distinct(), "id", "left_semi")
    out = ids.join(hydrate(asked, base, verify), "id", "left")
    known = ids.join(asked.select("id", F.lit(True).alias("known")), "id", "left").select("pos", "known")
    return out.join(known, "pos").withColumn("reason", F.when(F.col("known").isNull(), "not_found").otherwise(F.col("reason"))).drop("known").orderBy("pos")


def audit(memories: DataFrame, base: str | None = None, verify: bool = True, full: bool = False) -> DataFrame:
    """The audit and full profiles: content with provenance; failures are warnings, not errors."""
    read = hydrate(memories, base, verify)
    keep = ["id", "identifier", "memory_type", "source_uri", "source_checksum", "provenance_json", *(["fact_text", "metadata_json"] if full else [])]
    return memories.select(*keep).join(read, "id").withColumn("warning", F.when(F.col("reason").isNotNull(), F.concat(F.col("reason"), F.lit(": "), F.col("source_uri")))).drop("reason")
