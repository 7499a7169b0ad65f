"""Connected components as distributed union-find: alternating large and small stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import shared_folder, tidy

#: Links that one task writes, about: links are few beside what they come from, and small files cost more than they hold.
TASK_LINKS = 200_000


def _cut(e: DataFrame, links: int) -> DataFrame:
    """The links without their lineage, in the shared folder."""
    shared_folder(e.sparkSession)
    with tidy(e.sparkSession):
        return e.coalesce(1 + links // TASK_LINKS).checkpoint(eager=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges (src, dst) that isn't the smallest of its component.

    Self links, repeated links and links with null ends don't count; no links make no rows. Each round halves what stands
    between a node and its component's smallest; a round's links are cut from their lineage in the shared folder.
    """
    e = edges.where("src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    shared_folder(e.sparkSession)
    with tidy(e.sparkSession):
        e = e.checkpoint(eager=True)
    seen = _state(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        e = _cut(small.unionByName(low.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct(), seen[0])
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
