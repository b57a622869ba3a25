"""The append-only event log: filters, keyset pages, retention, replay; and replay of another store's audit history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.dedup import first_by_hash
from mnemolake.schema import MEMORY, conform, ddl

#: The event types.
TYPES = ("memory.created", "memory.promotion", "memory.candidate", "snapshot.imported", "bundle.imported", "bundle.discovered", "hygiene.checked", "hygiene.warning")


def utc(stamp: Column) -> Column:
    """A stamp with an offset as UTC text, so that text order is time order; one in UTC already and unreadable ones stay."""
    there = F.to_utc_timestamp(F.try_to_timestamp(stamp), F.current_timezone())
    offset = stamp.rlike(r"[0-9][+-][0-9]{2}:?[0-9]{2}$") & stamp.contains(":")
    return F.when(offset, F.coalesce(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss'Z'"), stamp)).otherwise(stamp)


def utc_text(stamp: str) -> str:
    """The same for a value, so that a condition on it still reaches the scan."""
    try:
        at = dt.datetime.fromisoformat(stamp)
    except ValueError:
        return stamp
    return stamp if at.tzinfo is None or stamp.endswith("Z") else at.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def select_events(events: DataFrame, memory_id=None, namespace=None, event_type=None, since=None, until=None, after_seq=None, before_seq=None) -> DataFrame:
    """since and until are inclusive and may have an offset, the cursors exclusive; every condition reaches the scan."""
    for name, value in (("memory_id", memory_id), ("namespace", namespace), ("event_type", event_type)):
        if value is not None:
            events = events.where(F.col(name) == value)
    for value, test in ((since, lambda v: F.col("occurred_at") >= v), (until, lambda v: F.col("occurred_at") <= v), (after_seq, lambda v: F.col("seq") > v), (before_seq, lambda v: F.col("seq") < v)):
        if value is not None:
            events = events.where(test(utc_text(value) if isinstance(value, str) else value))
    return events


def page(events: DataFrame, limit: int = 100, ascending: bool = True, **conditions) -> DataFrame:
    return select_events(events, **conditions).orderBy(F.asc("seq") if ascending else F.desc("seq")).limit(limit)


def trim_before(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("seq") >= seq)


def trim_to(events: DataFrame, keep: int) -> DataFrame:
    """The last `keep` events. The bound is one number: the smallest seq that stays."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    if keep == 0:
        return events.limit(0)
    bound = events.select("seq").orderBy(F.desc("seq")).limit(keep).agg(F.min("seq").alias("bound"))
    return events.join(F.broadcast(bound), F.col("seq") >= F.col("bound")).drop("bound")


def created_rows(events: DataFrame, after_seq: int = 0) -> DataFrame:
    """Memory rows of memory.created events, first of each hash; a null keeps its default, 0 stays 0."""
    made = events.where((F.col("event_type") == "memory.created") & F.col("memory_id").isNotNull() & (F.col("seq") > after_seq))
    rows = made.select("seq", F.col("memory_id"), F.from_json("payload_json", ddl(MEMORY)).alias("p")).select("seq", "memory_id", "p.*").withColumn("id", F.coalesce("id", "memory_id"))
    return conform(first_by_hash(rows.fillna({"content_hash": ""}), ["seq"]))


def payload(memories: DataFrame) -> Column:
    """All columns of a row as JSON, nulls left out."""
    return F.to_json(F.struct(*(F.col(c) for c in memories.columns)))


def audit_states(history: DataFrame, default_actor: str = "imported") -> DataFrame:
    """(memory_id, identifier, fact_text, created_at, gone) for each memory_id of an audit history, a table or a stream.

    In order of created_at and id, a deletion ends an epoch; in an epoch the last non-blank text stands, with its actor
    and time. A memory is gone unless its last epoch has a text: unless its last text isn't before its last deletion. Both are
    maxima, so they merge: a memory of many changes makes no hot window, and a stream holds the two of each memory as state
    and gives the same result however its batches are cut. Of texts at the same place the greatest stands.
    """
    dead = F.coalesce((F.col("event") == "DELETE") | (F.coalesce(F.col("is_deleted"), F.lit(0)) != 0), F.lit(False))
    place = F.struct("created_at", "id")
    said = ~dead & F.col("new_memory").rlike(r"(?U)\S")
    last = history.groupBy("memory_id").agg(F.max(F.when(dead, place)).alias("died"), F.max(F.when(said, F.struct(place.alias("place"), "new_memory", "actor_id", "created_at"))).alias("x"))
    there = F.col("x").isNotNull() & (F.col("died").isNull() | (F.col("x.place") >= F.col("died")))
    return last.select("memory_id", F.coalesce(F.nullif("x.actor_id", F.lit("")), F.lit(default_actor)).alias("identifier"), F.col("x.new_memory").alias("fact_text"), F.col("x.created_at").alias("created_at"), (~there).alias("gone"))


def audit_replay(history: DataFrame, default_actor: str = "imported") -> DataFrame:
    """The last state of each memory_id that isn't gone: identifier, fact_text, created_at."""
    return audit_states(history, default_actor).where("NOT gone").drop("gone")
