"""Connected components of links, by alternating stars.

Each round sends every node's larger neighbours, then its smaller ones, to the
least node it knows.  The number of rounds grows with the logarithm of the
longest way; least neighbours are found by aggregation, so that a node with
very many links is summed up where its links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shared import drop, settle


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("least"))


def _round(links: DataFrame) -> DataFrame:
    """links (u, v) with u > v, after one large and one small star."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    low = _least(large)
    small = large.join(low, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return small.unionByName(low.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that links lead to) of every node of the links (a, b), but the roots themselves."""
    now = settle(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = settle(_round(now), "links")
        drop(now)
        now, mark = after, seen
