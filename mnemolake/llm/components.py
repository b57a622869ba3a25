"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one shuffle of the edges; their number grows with the logarithm of the longest chain. A hub, a node of so
many arcs that one task would feel it, meets its smallest neighbour by broadcast, so that its arcs stay where they lie:
n edges have at most MOST_HUBS such nodes, as the number of arcs that makes a hub grows with n. The table is final when
each node points at one that points nowhere. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import discard, materialise

#: A node with more arcs than this is a hub; where that would allow more hubs than MOST_HUBS (4 MB), the bound is raised.
HUB_ARCS, MOST_HUBS = 256, 1 << 16


def _star(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """One step over edges (a, b), a > b, which may repeat; large: seen from both ends, the centre is a, its neighbours b. hub is None where there are none."""
    arcs = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    few = arcs
    if hub is not None:
        least = arcs.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("arcs")).where(F.col("arcs") > hub)
        hubs, met = F.broadcast(least.select(F.col("a").alias("centre"), F.least("a", "low").alias("low"))), F.col("a") == F.col("centre")
        few = arcs.join(hubs.select("centre"), met, "left_anti")
    # the neighbours of a node that is no hub are a row, so that its arcs are shuffled once
    near = few.groupBy("a").agg(F.collect_set("b").alias("near"))
    low = F.least("a", F.array_min("near")).alias("low")
    # large: every neighbour beyond the centre; small: all of them and the centre
    out = near.select(low, F.explode(F.filter("near", lambda b: b > F.col("a")) if large else F.array_append("near", F.col("a"))).alias("node"))
    if hub is not None:
        far = arcs.join(hubs, met)
        ends = far.where(F.col("b") > F.col("a")).select("low", F.col("b").alias("node")) if large else far.select("low", F.explode(F.array("b", "a")).alias("node"))
        out = out.unionByName(ends)
    return out.where(F.col("node") != F.col("low")).select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b"))


def _shape(edges: DataFrame) -> tuple[int, int, bool]:
    """(edges, most arcs of a node, whether each node points at one that points nowhere)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = nodes.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.max(F.greatest("up", F.when(F.col("down") > 0, F.col("up") + 1).otherwise(0)))).first()
    return row[0] or 0, row[1] or 0, (row[2] or 0) <= 1


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Loops and repeated edges are as good as none; null ends make no edge; an empty table has no nodes.
    """
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    n, most, done = _shape(now)
    while not done:
        bound = max(HUB_ARCS, -(-2 * n // MOST_HUBS))
        hub = bound if most > bound else None
        spread = _star(now, large=True, hub=hub)
        # with hubs a step reads its edges several times, so they are a table
        spread = spread if hub is None else materialise(spread, label)
        then = materialise(_star(spread, large=False, hub=hub).distinct(), label)
        if hub is not None:
            discard(spread)
        discard(now)
        now = then
        n, most, done = _shape(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
