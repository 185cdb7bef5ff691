"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage


def _stars(links: DataFrame, smaller: bool) -> DataFrame:
    """Tie the neighbours of every node to the smallest of them and the node.

    ``smaller``: only neighbours below the node (and the node itself), else only those above it.
    The minimum is pre-aggregated, so a node with very many links is no single task's work.
    """
    both = links if smaller else links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if smaller:
        made = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        made = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return made.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.  Nodes without links are not returned."""
    now = stage(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links"
    )
    mark = None
    while True:
        now = stage(_stars(_stars(now, smaller=False).select("a", "b"), smaller=True), "stars")
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(got)
