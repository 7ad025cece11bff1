"""Connected components of a graph of any size, by alternating star joins.

Defined cases: a pair may repeat, in either order; a pair of a node with itself links nothing,
and a node with no other pair has no row; nodes of any type that Spark can order; a pair
with a null end is left out; no pairs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeforge.session import stage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step of the large-star or small-star rule over edges (a, b) with a > b.

    Every node links its larger (or its smaller) neighbours to the smallest node it
    knows, itself included. Groups are reduced to their minimum before they are joined.
    """
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        rows = both.filter("b > a")
    else:
        least, rows = edges.groupBy("a").agg(F.min("b").alias("m")), edges
    # Read from files on both sides, the join can split a node with many neighbours.
    least = stage(least, "least")
    linked = rows.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return linked.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its smallest node.

    Each round writes its edges to the shared folder, so that lineage stays short; only
    a row count and a checksum reach the driver. The rounds grow with the logarithm of
    the longest chain.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(pairs.filter("a > b").distinct(), "links")
    sums = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = edges.agg(*sums).first()
    while seen["n"]:
        edges = stage(_stars(_stars(edges, True), False), "links")
        now = edges.agg(*sums).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
