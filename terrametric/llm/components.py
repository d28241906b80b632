"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations and joins over links; no component, however
large, is held in one task. A round's links are written to the shared folder,
so a lost executor repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with the `m` of their u.

    The key is wrapped, so that both sides are dealt out for the join alone and
    Spark can split the links of a node that has very many.
    """
    key = F.struct(F.col("u").alias("k"))
    return links.select(key.alias("key"), "u", "v").join(least.select(key.alias("key"), "m"), "key").select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node next to it."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch, rounds: int = 60, name: str = "links") -> DataFrame:
    """(node, root) for each linked node but the roots themselves; root is the least node reachable.

    links: columns u and v of any ordered type. Repeated links, both directions
    and links of a node to itself are allowed; links with a null are ignored.
    name: begins those of the tables that are written, of which one stays.
    """
    now = scratch.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state = None
    for k in range(1, rounds + 1):
        now = scratch.save(_small_star(_large_star(now)), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        # The same links twice: every node is linked to its root. Sums over hashes tell sets apart.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
