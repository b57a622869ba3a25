"""Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

AGENT_CHARS = 4096
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def non_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def epoch(stamp: Column) -> Column:
    """Seconds of an ISO stamp; null where it can't be read."""
    return F.unix_timestamp(F.try_to_timestamp(stamp))


def ttl_live(now: Column | int, created_at: str = "created_at", ttl: str = "ttl_seconds") -> Column:
    """No ttl, or an age below it; null (so excluded by a filter) where created_at can't be read."""
    return F.col(ttl).isNull() | ((F.lit(now) - epoch(F.col(created_at))) < F.col(ttl))


def not_archived() -> Column:
    return F.col("promotion_state") != "ARCHIVED"


def content_hash(identifier: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(identifier, F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)


def file_hash(identifier: Column, uri: Column, offset: Column, length: Column, checksum: Column) -> Column:
    """The hash of a reference; reads no bytes."""
    return F.sha2(F.concat_ws(":", identifier, uri, offset.cast("string"), length.cast("string"), F.coalesce(checksum, F.lit(""))), 256)


def search_text() -> Column:
    return F.coalesce(non_empty(F.col("fact_text")), non_empty(F.col("fact_summary")))


def agent_truncate(text: Column, limit: int = AGENT_CHARS) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def resolve_uri(uri: Column, base: str) -> Column:
    """Absolute paths and uris with a scheme stay; others lie under base."""
    return F.when(uri.startswith("/") | uri.contains("://"), uri).otherwise(F.concat(F.lit(posixpath.join(base, "")), uri))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """0 where either is null, empty or zero, or the lengths differ."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & (norms > 0), dot(x, y) / norms).otherwise(F.lit(0.0))


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def stored_vector_ok(encoded: Column, dim: Column, model: Column, want_dim: int, want_model: str) -> Column:
    """Whether a stored base64 vector may be used again instead of embedding anew."""
    raw = F.try_to_binary(encoded, F.lit("base64"))
    return F.coalesce((dim == want_dim) & (model == want_model) & (F.octet_length(raw) == 4 * want_dim), F.lit(False))
