"""Connected components of a link table, by alternating large and small stars.

Each step replaces a node's links by links to the smallest node it sees (Kiveris et
al., 2014). Links stay distributed; a node with very many links costs a partial
minimum before each shuffle, and its join partition can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, keep_smaller: bool) -> DataFrame:
    """links: (u, v). Links v (and, keeping smaller ones, u) to the least of u and its neighbours.

    Repeated links count once; no links give none. Ends are not null.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if keep_smaller:  # every neighbour is smaller than u
        pairs = joined.select(F.explode(F.array("u", "v")).alias("v"), "m").where("v != m")
    else:
        pairs = joined.where("v > u").select("v", "m")
    return pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b of one orderable type).

    root is the smallest node that the node reaches. Loops and repeated links are
    allowed; links with a null end are left out; no links give no rows.
    """
    links = cut(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = cut(_star(_star(both, False), True), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
