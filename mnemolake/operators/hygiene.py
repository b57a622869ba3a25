"""Advisory checks of a store. Sizes are counts of characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The thresholds.
LARGE_INLINE, MANY_ROWS, MUCH_INLINE, MANY_FILES = 131072, 1000, 10485760, 100
COLUMNS = ("category", "severity", "subject", "amount")


def stats(memories: DataFrame) -> DataFrame:
    """One row; a single aggregate."""
    file = F.col("memory_type") == "file"
    size = F.char_length(F.coalesce("fact_text", F.lit(""))).cast("long")
    return memories.agg(
        F.count("*").alias("total"),
        F.count_if(~file).alias("inline_count"),
        F.count_if(file).alias("file_count"),
        F.coalesce(F.sum(F.when(~file, size)), F.lit(0)).alias("inline_chars"),
        F.coalesce(F.sum(F.when(file, F.coalesce("byte_length", F.lit(0)))), F.lit(0)).alias("file_bytes"),
        F.coalesce(F.max(F.when(~file, size)), F.lit(0)).alias("largest_inline"),
    )


def warnings(memories: DataFrame, missing: DataFrame | None = None, stale: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(category, severity, subject, amount). missing: (id, checkable) of file rows without a file; stale: (path); known: stats() of memories, where a store has them."""
    file = F.col("memory_type") == "file"
    row = lambda df, category, severity, subject, amount: df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), subject.cast("string").alias("subject"), amount.cast("long").alias("amount"))
    size = F.char_length("fact_text")
    one, empty = stats(memories) if known is None else known, F.lit(None)
    found = [
        row(memories.where(~file & (size > LARGE_INLINE)), "large_inline", "warn", F.col("id"), size),
        row(one.where(F.col("total") > MANY_ROWS), "growth", "info", empty, F.col("total")),
        row(one.where(F.col("inline_chars") > MUCH_INLINE), "growth", "warn", empty, F.col("inline_chars")),
        row(one.where(F.col("file_count") > MANY_FILES), "attachment_growth", "info", empty, F.col("file_count")),
    ]
    if missing is not None:
        found.append(row(missing, "missing_backing_file", F.when(F.col("checkable"), "error").otherwise("warn"), F.col("id"), empty))
    if stale is not None:
        found.append(row(stale, "stale_bundle", "warn", F.col("path"), empty))
    return reduce(DataFrame.unionByName, found)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))
