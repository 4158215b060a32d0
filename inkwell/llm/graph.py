"""Connected components of an edge list that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialise

#: Up to so many edges, the table of minima (two rows an edge at most) is broadcast.
STAR_BROADCAST_EDGES = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (columns ``u``, ``v``, long) with their smallest reachable node.

    Alternates large-star and small-star contraction until nothing changes, O(log n) rounds, each
    written to the shared folder in place of the one before. Returns ``node``, ``component`` for every node but the smallest of each
    component; isolated nodes, self-loops and edges with a null end give no row. An empty edge
    list gives an empty result. Hubs are safe: minima are aggregated before they are shuffled,
    and joins read written tables, so adaptive execution splits a hub's rows.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialise(e, "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, few, last = now, now[0] <= STAR_BROADCAST_EDGES, e
        e = _large_star(e, few)
        e = materialise(_small_star(e if few else materialise(e, "star"), few), "star")
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _minima(pairs: DataFrame, few: bool) -> DataFrame:
    """The smallest ``v`` of each ``u``: two rows an edge at most, so few edges bound a broadcast."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(m) if few else materialise(m, "minima")


def _large_star(e: DataFrame, few: bool) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_minima(both, few), "u").where("v > u")
    return out.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame, few: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    joined = e.join(_minima(e, few), "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
