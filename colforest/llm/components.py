"""Connected components of an edge table, without collecting it anywhere.

Alternating large-star and small-star rounds: each node's larger neighbours, then its smaller ones, are
hung on its smallest neighbour, until every component is a star around its smallest node.  Each round is
written to the shared folder, so lineage stays short and an executor may be lost; the round before it goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_stored, stored


#: Edges of a node that one task takes; the hub of a larger star is dealt to several.  Up to so many hubs are broadcast.
HUB_EDGES, MOST_BROADCAST = 5_000, 50_000


def _hung(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (u, v), about ``rows`` of them, with m, the smallest of u and its neighbours.

    A partial aggregate leaves each task.  Hubs' rows are salted, and their minimum goes to every salt.  There is at
    most one hub for every HUB_EDGES rows; they are broadcast only while that makes no more than MOST_BROADCAST, and
    joined by a shuffle beyond."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low"), F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("parts"))
    least = least.select("u", F.least("u", "low").alias("m"), "parts")
    hubs = least.where("parts > 1").select("u", F.col("parts").alias("_parts"))
    hubs = F.broadcast(hubs) if rows <= HUB_EDGES * MOST_BROADCAST else hubs
    salted = pairs.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int").alias("salt"))
    return salted.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")), ["u", "salt"])


def _large(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame, rows: int) -> DataFrame:
    hung = _hung(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), rows)
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(hung.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``edges(u long, v long)`` -> ``(u, v)``: every node but the smallest of its component, with that smallest one."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = F.xxhash64("u", "v") % F.lit(1_000_003)
    state = edges.agg(F.count("*"), F.sum(mark)).first()
    while state[0]:
        before, edges = edges, stored(_small(_large(edges, state[0]), 2 * state[0]).distinct(), name)
        drop_stored(before)
        new = edges.agg(F.count("*"), F.sum(mark)).first()
        if new == state:
            break
        state = new
    return edges
