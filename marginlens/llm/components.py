"""Connected components of a link table, by alternating star contractions.

Each round replaces the edges of a node by edges to its smallest neighbour, first towards larger neighbours and then
towards smaller ones, until every component is one star around its smallest node; the number of rounds grows with the
logarithm of the longest chain. A round is two grouped minima joined back to the edges, so a node with very many edges is
pre-aggregated before the shuffle and split by adaptive skew joins. Rounds are written to the shared folder, which cuts the
lineage and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import stage


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    least = _smallest(edges)
    others = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(others).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another node; root is the smallest node of its component.

    ``links`` holds undirected links between BIGINT nodes in columns ``a`` and ``b``. Repeated links and links of a node to
    itself change nothing, links with a null end are ignored, no link gives no row.
    """
    one_way = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stage(one_way, "links")
    state = _state(edges)
    while state[0]:
        edges = stage(_small_star(stage(_large_star(edges), "large-star")), "small-star")
        previous, state = state, _state(edges)
        if state == previous:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
