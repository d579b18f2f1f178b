"""Connected components of an edge table, without bringing edges together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


#: A node of so many edges is a hub; hubs' minima are broadcast.
HUB_EDGES = 1_000
#: Hubs at most: with more edges a hub needs more of them.
HUBS = 10_000


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots; the
    root is the smallest node of the component.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones.  Minima are partial
    aggregates, and the edges of hubs, of which there are at most ``HUBS``, are
    not brought together: they meet their hub's minimum by a broadcast.  Each
    round is written to the shared folder, so a lost executor costs one round
    at most.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"), "n")
        hub = max(HUB_EDGES, 2 * state[0] // HUBS)  # the edges, each seen from two sides, make at most HUBS such nodes
        hubs = least.where(F.col("n") > hub).select(F.col("x").alias("hub"), F.col("m").alias("hub_m"))
        met = both.where("b > a").join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
        of_hubs = met.where("hub IS NOT NULL").select(F.col("b").alias("a"), F.col("hub_m").alias("b"))
        others = met.where("hub IS NULL").join(least.where(F.col("n") <= hub), F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = of_hubs.union(others).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        small = large.join(smallest, F.col("a") == F.col("x")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now = written(small, name, rows=state[0])  # steps never add edges
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))).first()
    return (row[0], row[1] or 0, row[2] or 0)
