"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) both ways -> every neighbour linked to the smallest one around its node."""
    ways = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        ways = ways.where("v < u")
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = ways.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: no node has two smaller neighbours, and no smaller neighbour has any."""
    nodes = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(True))
    return nodes.join(roots, "u", "left").where("n > 1 or root").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v); root is the smallest node of its component."""
    edges = scratch.staged(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _stars(edges):
        before, edges = edges, scratch.staged(_starred(_starred(edges, True), False), "edges")
        scratch.drop(before)
    # Converged: every node hangs on its root.
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
