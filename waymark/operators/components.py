"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_large_and_measure as cut_and_measure


def _star(links: DataFrame) -> DataFrame:
    """Hook ``v`` of every row (u, v) to the smallest node seen at ``u``."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least.hint("merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hooked = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a checksum by which a round without change is seen."""
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table, seen = cut_and_measure(edges, n=F.count(F.lit(1)), checksum=checksum)
    return table, (seen["n"], seen["checksum"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; the label is the smallest node of its component.

    Minima are combined before the shuffle, so a node with a third of all edges costs one row per task; the
    joins back are plain sort-merge joins, which adaptive execution splits when a node is hot.
    """
    given, mark = _write(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    current = given.where("u <> v")
    while mark[0]:
        seen = mark
        current, mark = _write(_small_star(_large_star(current)))
        if seen == mark:
            break
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(label.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
