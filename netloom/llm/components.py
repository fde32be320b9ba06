"""Connected components of a graph given as a table of links between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Links go from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least).distinct()


def stars(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each node that is not the smallest of its component, with that smallest node.

    Alternates two kinds of star until nothing changes; the number of rounds grows with the logarithm of the
    size. Each round is written to the shared folder, so lineage stays short and a lost executor costs one
    round's work. NULL ends and self-links are ignored.
    """
    now = links.toDF("u", "v").where("u != v")
    now = stage(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            return now
        before = seen
        now = stage(_small_star(_large_star(now)), name)
