"""Promotion states: only one step forward at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("HOT", "READY", "PROMOTED", "ARCHIVED")
STEPS = tuple(zip(STATES[:-1], STATES[1:], strict=True))


class InvalidTransition(ValueError):
    def __init__(self, memory_id: str, old: str, new: str):
        super().__init__(f"{memory_id}: {old} to {new} isn't allowed")
        self.memory_id, self.old, self.new = memory_id, old, new


def check(memory_id: str, old: str, new: str) -> None:
    if new not in STATES:
        raise ValueError(f"unknown state: {new}")
    if (old, new) not in STEPS:
        raise InvalidTransition(memory_id, old, new)


def states(spark) -> DataFrame:
    return spark.createDataFrame([(s, i, [b for a, b in STEPS if a == s]) for i, s in enumerate(STATES)], "state string, position int, next array<string>")


def validate(requests: DataFrame) -> DataFrame:
    """requests (..., promotion_state, to_state) with `valid`; the three steps are a literal."""
    step = F.concat_ws(">", "promotion_state", "to_state")
    return requests.withColumn("valid", step.isin(*(f"{a}>{b}" for a, b in STEPS)))


def apply_updates(versions: DataFrame, updates: DataFrame) -> DataFrame:
    """Versions with the latest later value of (id, seq, promotion_state, promotion_candidate, updated_at), null: unchanged."""
    marked = versions.select("id", F.col("seq").alias("_of")).join(updates, "id").where(F.col("seq") > F.col("_of"))
    last = marked.groupBy("id", "_of").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in ("promotion_state", "promotion_candidate", "updated_at")))
    out = versions.join(last.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("seq") == F.col("_of")), "left")
    for c in ("promotion_state", "promotion_candidate", "updated_at"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop("_id", "_of", "_promotion_state", "_promotion_candidate", "_updated_at")
