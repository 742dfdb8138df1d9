"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.stash import Stash

#: A node with more than max(HUB_ROWS, edges / HUB_SHARE) links is a hub, so there are at most 2 * HUB_SHARE hubs.
HUB_ROWS, HUB_SHARE = 1000, 1000


def _with_min(edges: DataFrame, key: str, mins: DataFrame, n_edges: int) -> DataFrame:
    """Adds to each edge the smallest neighbour ``m`` of its ``key`` end.

    Hubs are joined by broadcast: their number has a fixed bound. All other keys have few edges each, so
    the shuffled join has no large group.
    """
    most = max(HUB_ROWS, n_edges // HUB_SHARE)
    mins = mins.withColumnRenamed("node", key)
    hubs = F.broadcast(mins.where(F.col("c") > most).select(key, "m"))
    cold = mins.where(F.col("c") <= most).select(key, "m")
    near = edges.join(hubs, key).select("u", "v", "m")
    far = edges.join(hubs, key, "left_anti").join(cold, key).select("u", "v", "m")
    return near.unionByName(far)


def connected_components(edges: DataFrame, stash: Stash, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates the large-star and small-star steps until the edges no longer change; each round is written
    to the stash, so lineage stays short. Null ends and loops are dropped; an empty input gives no rows.
    """
    spark = stash.spark
    a, b = F.col("a"), F.col("b")
    now = stash.put(
        edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    nodes = now.where("u = v").select("u")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    first, now = now, now.where("u <> v")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("v").alias("node"), F.col("u").alias("w")).unionByName(
            now.select(F.col("u").alias("node"), F.col("v").alias("w"))
        )
        mins = both.groupBy("node").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("c"))
        mins = mins.select("node", F.least("node", "m").alias("m"), "c")
        large = _with_min(now, "v", mins, seen[0]).select("u", F.col("m").alias("v")).distinct()
        large = stash.put(large, "large")
        down = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = _with_min(large, "u", down, seen[0]).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        new = stash.put(small.distinct(), "small")
        after = state(new)
        stash.drop(large)
        if hasattr(now, "stash_path"):
            stash.drop(now)
        now, done, seen = new, after == seen, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    alone = nodes.select(F.col("u").alias("node"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select("v").unionByName(alone.select(F.col("node").alias("v"))).distinct()
    roots = roots.join(now.select(F.col("u").alias("v")), "v", "left_anti")
    return found.unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
