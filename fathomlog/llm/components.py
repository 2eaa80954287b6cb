"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import discard, materialize

#: Edges of a file, at least: few edges take few tasks and files in a round, however many parts shuffles have.
FILE_ROWS = 1 << 14


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed links with the smallest neighbour of each ``u`` (itself included)."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return links.join(least, "u"), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of ``edges`` (a, b).

    Each round is a few equi-joins; rounds grow with the logarithm of the longest path. Only a
    count and a checksum of the edges come to the driver. Loops and repeated edges do no harm.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _star(both)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small, least = _star(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        after = materialize(after.coalesce(max(1, mark[0] // FILE_ROWS)))
        seen, mark = mark, _mark(after)
        discard(edges)
        edges = after
        if seen == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
