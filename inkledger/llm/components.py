"""Connected components of an edge table by alternating large and small stars.

Only minima cross the shuffles before rows do: a node's smallest neighbour comes from a partial aggregate, and nodes that
hold a large share of all links, of which there can be few, are broadcast to them, so a centre with very many links is
never gathered in one task. Each round ends in a checkpoint; nothing is collected but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: A node is broadcast to its links if it has more than this many, and more than one in so many of the round's edges. The
#: large star lists each edge from both ends, the small star gets no more edges than it: at most 40,000 pairs of numbers
#: (under 1 MB) are broadcast.
HOT, SHARES = 100, 20_000


def _star(edges: DataFrame, large: bool, hot: int) -> DataFrame:
    """Link each node's larger (or smaller-or-equal) neighbours to its smallest neighbour.

    A node of more than ``hot`` links hands its smallest neighbour to wherever its links lie; the links of the others
    meet it in the node's own task.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ends = ends.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("links"))
    often = F.broadcast(low.where(F.col("links") > hot).select("u", F.col("m").alias("known")))
    met = (ends.where("v > u") if large else ends).join(often, "u", "left")
    out = met.where("known IS NOT NULL").select(F.col("v").alias("a"), F.col("known").alias("b"))
    out = out.unionAll(met.where("known IS NULL").join(low.select("u", "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
    if not large:
        out = out.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, component) for every node that has an edge; ``edges`` has long columns a and b, the component is the least.

    Nodes of more than ``hot`` links, and of more than one in ``SHARES`` of all, are joined by broadcast.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = durable(now), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        most = max(hot, mark["n"] // SHARES)
        now = durable(_star(_star(now, True, most), False, most))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
