"""First-wins and last-wins merges over ids and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.work import discard, materialise


def first_by_hash(rows: DataFrame, order: list[str], hash_column: str = "content_hash") -> DataFrame:
    """The first row of each hash; rows with an empty or a null hash never collide. Only a row each leaves a map task's group."""
    rank = F.row_number().over(W.partitionBy(hash_column).orderBy(*order))
    hashed = F.coalesce(F.col(hash_column) != "", F.lit(False))
    return rows.where(hashed).withColumn("_n", rank).where("_n = 1").drop("_n").unionByName(rows.where(~hashed))


def insert_order(rows: DataFrame, seq: str = "seq", key: str = "id", hash_column: str = "content_hash") -> DataFrame:
    """The rows that inserting in order of seq takes where an id or a non-empty hash that is there already is ignored.

    A row is in if no row that is in before it has its id or hash. The first of both its id and its hash is in, what shares
    either with it is out; that is repeated for what is left, which is nothing unless rows were first of one only. seq is
    unique and stays the same when rows are read again; an empty table gives no rows; ids that are null never collide.
    """
    left, taken = materialise(rows.select(seq, key, hash_column), "left"), None
    while True:
        by_id = left.groupBy(F.col(key).alias("_i")).agg(F.min(seq).alias("_first"))
        by_hash = left.where(F.col(hash_column) != "").groupBy(F.col(hash_column).alias("_h")).agg(F.min(seq).alias("_hashed"))
        won = left.join(by_id, F.col(key) == F.col("_i"), "left").join(by_hash, F.col(hash_column) == F.col("_h"), "left")
        won = won.where((F.col(key).isNull() | (F.col(seq) == F.col("_first"))) & (F.col("_hashed").isNull() | (F.col(seq) == F.col("_hashed")))).select(seq, key, hash_column)
        won = materialise(won, "won")
        taken = won if taken is None else taken.unionByName(won)
        rest = not_in_store(left.join(won.select(F.col(seq).alias("_s")), F.col(seq) == F.col("_s"), "left_anti"), won, key, hash_column)
        rest = materialise(rest, "left")
        discard(left)
        left = rest
        if left.isEmpty():
            discard(left)
            return rows.join(taken.select(F.col(seq).alias("_s")), F.col(seq) == F.col("_s"), "left_semi")


def not_in_store(rows: DataFrame, store: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't in the store; a null matches nothing, and an empty hash neither, while an empty id is an id."""
    for key in keys:
        known = F.col(key).isNotNull() if key == "id" else F.col(key) != ""
        rows = rows.join(store.where(known).select(key).distinct(), key, "left_anti")
    return rows


def merge(store: DataFrame, batch: DataFrame, order: list[str], hash_column: str = "content_hash") -> DataFrame:
    """The store and what of the batch is new to it, first wins."""
    return store.unionByName(not_in_store(first_by_hash(batch, order, hash_column), store, hash_column))


def live_versions(log: DataFrame) -> DataFrame:
    """What replaces leave of a mutation log (seq, id, content_hash, ...): a version lives if it is the last of its id and,
    where it has a hash, the last of its hash; a null id never collides. Both are over the whole log, so a version replaced by hash never comes back.

    The last seq of a key is a partial aggregate before its shuffle, so a hot key makes no hot window.
    """
    by_id = log.groupBy(F.col("id").alias("_i")).agg(F.max("seq").alias("_last"))
    by_hash = log.where("content_hash != ''").groupBy(F.col("content_hash").alias("_h")).agg(F.max("seq").alias("_hashed"))
    live = log.join(by_id, F.col("id") == F.col("_i"), "left").where(F.col("_last").isNull() | (F.col("_last") == F.col("seq"))).drop("_i", "_last")
    return live.join(by_hash, F.col("content_hash") == F.col("_h"), "left").where(F.col("_hashed").isNull() | (F.col("_hashed") == F.col("seq"))).drop("_h", "_hashed")
