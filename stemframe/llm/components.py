"""Connected components by alternating large-star and small-star, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.storage import discard, staged



def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step over edges (u > v). The joins start with plain exchanges, so hubs can be split.

    Large-star: every neighbour above a node is linked to the least of the node and its neighbours.
    Small-star: a node and its neighbours below are linked to the least of these.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        found = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = staged(found.filter("u > v").distinct(), "stars")
    discard(edges, least)
    return out


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that can be reached.

    Loops, repeated links and either direction are fine; links with a null are ignored; no links give no
    rows. The number of rounds grows with the logarithm of the nodes; only a count and a checksum of the
    links, one row, come to the driver in each.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or not now["n"]:
            break
        seen = now
        edges = _stars(_stars(edges, True), False)
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
