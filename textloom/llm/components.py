"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved

ROUNDS = 60


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with the least of ``u`` and its neighbours; the centres of large stars are not shuffled on."""
    stars = saved(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("n")))
    return join_hot(edges, stars, "u", total).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being its component's least node.

    Rounds of large-star and small-star until nothing changes; every round is a
    written table, so nothing grows in the plan or the driver.  Self-loops and
    repeated edges don't matter; an empty table gives no rows.
    """
    measure = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    now = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = now.agg(*measure).first()
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(_with_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct())
        small = _with_least(large, large.count())
        now = saved(
            small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()
        )
        last, state = state, now.agg(*measure).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
