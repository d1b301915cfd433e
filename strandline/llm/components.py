"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise


#: Neighbours from which on a node's rows are met by a broadcast, and how many such nodes are broadcast at most;
#: fewer edges than FEW are a moment's work for one task, and joined plainly.
HUB, MOST_HUBS, FEW = 512, 1_000_000, 100_000


def _beside_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``rows`` with m of their a; ``least`` has a, n (its neighbours) and m.

    Nodes with more than h neighbours are fewer than two edges in h. h is HUB, or as much
    more as keeps them within MOST_HUBS, so they are always broadcast and no task gets all
    rows of one; any other node has at most HUB rows, or a millionth of all.
    """
    if n_edges < FEW:
        return rows.join(least.select("a", "m"), "a")
    hub = max(HUB, -(-2 * n_edges // MOST_HUBS))
    hubs = F.broadcast(least.where(F.col("n") > hub).select("a", F.col("m").alias("_hub")))
    both = rows.join(hubs, "a", "left")
    rest = both.where("_hub IS NULL").drop("_hub").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
    return rest.unionByName(both.where("_hub IS NOT NULL").withColumnRenamed("_hub", "m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node reachable) for each node of ``edges`` (a, b), loops aside.

    Each round hangs the neighbours of every node on the smallest of them, first the
    larger ones, then the smaller ones; after about log(n) rounds only stars are left.
    Minima are grouped with partial sums, and neighbours get them by a join in which nodes
    with very many neighbours are broadcast, so such a node loads no single task.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    state, n_edges = None, now.count()
    if not n_edges:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m"))
        large = _beside_least(both.where("b > a"), least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        small = _beside_least(large, least, n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct(), name)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state, n_edges = after, after[0]
