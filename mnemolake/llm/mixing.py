"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get integer quotas of equal-token blocks by highest quotients target / (2k - 1). The rule is house-monotone, so
the quotas of the first j shards are the apportionment of j shards' blocks, and a shard's own quotas are differences.
No quotient list is made: a divisor gives each source's quota up to the few seats that are left, and only the
quotients around it compete. A source's blocks lie along its documents in the order of a seeded hash, pass after pass;
each shard in turn takes the next blocks of every source, as many as its quota says. A document's share in a shard is
the overlap of its token ranges, one for each pass, with the shard's blocks. That needs its offset only: prefix sums over
hash ranges, then within each. Words are counted once; how many ranges there are follows from the number of documents.

The blocks have up to BLOCK_TOKENS tokens; fewer where the smallest source would have under BLOCKS_AT_LEAST of them.

Defined results: a null text has no tokens; the null source is a source, last in order; sources without tokens get
target 0; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.llm.common import materialise, whole_text

WEIGHTS = (5, 2, 1)
#: The mix's tokens, and a source's at most, as multiples of what there is.
SHARE, REPEAT = 1.5, 2
BLOCK_TOKENS, BLOCKS_AT_LEAST, SHARDS = 1024, 256, 16
#: The 60-bit hash is split into ranges for prefix sums, so many that a source of all documents has about RANGE_ROWS in each.
RANGE_ROWS = 1 << 7
#: Rows of one id and size that one task gives their places.
GROUP_ROWS = 1 << 14
_HASH_BITS = 60


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(seed: str) -> Column:
    """60 bits of a seeded hash of the id: where a document lies in its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _sized(documents: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, place, part) as a table: what the mix needs of the texts, counted once."""
    rows = materialise(documents.select("doc_id", "source", tokens(whole_text()).alias("size"), _place(seed).alias("place")), "sized")
    bits = max(4, min(20, (rows.count() // RANGE_ROWS).bit_length()))
    return rows.withColumn("part", F.shiftright("place", _HASH_BITS - bits).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target): weights by rank, capped, the excess reshared.

    Sources in order of cap over weight fill up first; the level follows from prefix sums, so nothing is repeated.
    The table has a row for each source, which is what its windows order.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", weight)
    s = s.withColumn("cap", (F.col("source_size") * REPEAT).cast("double"))
    filling = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everyone = filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everyone) * F.lit(SHARE))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("after", F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("full", F.col("cap") * F.col("after") <= (F.col("total") - F.col("before")) * F.col("weight"))
    s = s.withColumn("taken_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everyone))
    s = s.withColumn("left_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everyone))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("taken_cap")) / F.col("left_weight"))
    return s.select("source", "source_size", "rank", target.alias("target"))


def shard_quotas(targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, source_size, rank, target) to those and block, shard, quota, held (quota of this and earlier shards).

    With n sources and divisor d = total / seats, rounding target / d misses the seats by n / 2 at most, and the right
    divisor moves no source's quotient by more than n / 2 times its share of the total. So that many quotients on each
    side of the rounded quota suffice for the exact result, about 5 n for each shard together.
    """
    everyone = W.partitionBy(F.lit(0))
    t = targets.withColumn("n", F.count("*").over(everyone)).withColumn("total", F.sum("source_size").over(everyone) * F.lit(SHARE))
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everyone)
    t = t.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(least / BLOCKS_AT_LEAST))), F.lit(1)).cast("long"))
    t = t.withColumn("most", REPEAT * F.ceil(F.col("source_size") / F.col("block")))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("seats", F.floor(F.floor(F.col("total") / F.col("block")) * F.col("shard") / F.lit(shards)))
    exact = F.when(F.col("total") > 0, F.col("target") * F.col("seats") / F.col("total")).otherwise(0.0)
    slack = F.when(F.col("total") > 0, F.ceil(F.col("n") / 2 * F.col("target") / F.col("total"))).otherwise(F.lit(0)) + 1
    t = t.withColumn("slack", slack).withColumn("base", F.greatest(F.lit(0), F.floor(exact + 0.5) - F.col("slack")))
    t = t.withColumn("rest", F.col("seats") - F.sum("base").over(W.partitionBy("shard")))
    rivals = t.withColumn("seat", F.explode(F.sequence(F.col("base") + 1, F.col("base") + 2 * F.col("slack") + 2)))
    rivals = rivals.withColumn("allowed", F.col("seat") <= F.col("most")).withColumn("quotient", F.when(F.col("allowed"), F.col("target") / (2 * F.col("seat") - 1)))
    rivals = rivals.withColumn("place", F.row_number().over(W.partitionBy("shard").orderBy(F.col("quotient").desc_nulls_last(), "rank", "seat")))
    won = F.sum(F.when(F.col("allowed") & (F.col("place") <= F.col("rest")), 1).otherwise(0))
    held = rivals.groupBy("source", "source_size", "rank", "target", "block", "shard").agg((F.first("base") + won).alias("held"))
    before = F.lag("held", 1, 0).over(W.partitionBy("rank").orderBy("shard"))
    return held.withColumn("quota", F.col("held") - before)


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How much [a, b) and [c, d) have in common."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def _started(sized: DataFrame) -> DataFrame:
    """(source, part, doc_id, size, start): each row with the words before it in its part.

    Rows of one id and size can't be told apart, so they are counted before they are ordered: an id that many rows have,
    a null one among them, is a row for each of its sizes in the window. Copies get their places afterwards, those of a
    group beyond GROUP_ROWS in tasks of their own.
    """
    groups = sized.groupBy("source", "part", "place", "doc_id", "size").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    inside = W.partitionBy("source", "part").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    groups = groups.withColumn("start", F.sum(words).over(inside) - words)

    def each(rows: DataFrame) -> DataFrame:
        at = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + GROUP_ROWS, F.col("copies")) - 1))
        return rows.withColumn("at", at).select("source", "part", "doc_id", "size", (F.col("start") + F.col("at") * F.col("size")).alias("start"))

    few = each(groups.where(F.col("copies") <= GROUP_ROWS).withColumn("first", F.lit(0).cast("long")))
    many = groups.where(F.col("copies") > GROUP_ROWS).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(GROUP_ROWS).cast("long"))))
    return few.unionByName(each(many.repartition("source", "place", "doc_id", "size", "first")))


def mix(documents: DataFrame, seed: str = "mix", shards: int = SHARDS) -> DataFrame:
    """One row for each row of documents: doc_id, source, size, source_size, target, taken, block, shards.

    shards has the words taken for each shard that takes any, as struct(shard, words); taken is their sum.
    """
    sized = _sized(documents, seed)
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    quotas = shard_quotas(source_targets(sources), shards)
    # a source's blocks by shard: where each ends, in order; quotas of earlier shards come first
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "held"))), lambda x: x["held"])
    totals = quotas.groupBy("rank").agg(F.first("source").alias("s"), *(F.first(c).alias(c) for c in ("source_size", "target", "block")), ends.alias("ends"))
    offsets = parts.withColumn("part_start", F.sum("part_size").over(W.partitionBy("source").orderBy("part")) - F.col("part_size"))
    plan = offsets.join(totals, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("part").alias("p"), "part_start", "source_size", "target", "block", "ends")
    rows = _started(sized).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    rows = rows.withColumn("start", F.col("start") + F.col("part_start")).withColumn("turn", F.ceil(F.col("source_size") / F.col("block")) * F.col("block"))

    def words(i: Column) -> Column:
        """What shard i, from 0, takes of the document, over all passes."""
        begin, end = F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0)) * F.col("block"), F.get("ends", i) * F.col("block")
        starts = [F.col("start") + F.col("turn") * n for n in range(REPEAT)]
        return sum((_overlap(at, at + F.col("size"), begin, end) for at in starts), F.lit(0))

    taken = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct((i + 1).alias("shard"), words(i).cast("long").alias("words")))
    rows = rows.withColumn("shards", F.filter(taken, lambda x: x["words"] > 0))
    total = F.aggregate("shards", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", total.alias("taken"), "block", "shards")
