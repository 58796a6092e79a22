"""Connected components of links that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postresp.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) for every node of ``links`` (a, b).

    Rounds of contraction: every node moves to the neighbour (or itself) of the
    lowest pseudorandom priority, links are rewritten, and nodes without links
    are done.  Random priorities make a long chain shrink by a constant factor
    a round.  Each round is written to the shared folder; minima are combined
    before the shuffle, so a node with very many links is no hot group.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct(), "links")
    place = None          # node -> where it is now
    turn = 0
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        moves = stored(edges.groupBy("a").agg(F.min(rank("b")).alias("low"))
                       .select("a", F.least("low", rank("a"))["n"].alias("to")), "moves")
        if place is None:
            place = moves.select(F.col("a").alias("node"), F.col("to").alias("at"))
        else:
            place = (place.join(moves, place.at == moves.a, "left").select("node", F.coalesce("to", "at").alias("at")))
        place = stored(place, "places")
        left = edges.join(moves, "a").select(F.col("to").alias("a"), "b")
        moved = left.join(moves.select(F.col("a").alias("b"), F.col("to").alias("b_to")), "b").select("a", F.col("b_to").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), "links")
        turn += 1
    if place is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    low = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(low, "at").select("node", "component")
