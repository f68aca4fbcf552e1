"""Connected components of a table of links, as Spark joins.

Alternating large-star and small-star steps: each node links itself and its
larger (or smaller) neighbours to its least neighbour, until nothing changes;
then every link runs from a node to the least node of its component.  Rounds
grow with the logarithm of the graph's width.  Minima are taken with a partial
aggregate and joined back, so a node with very many links is never gathered in
one place, and a skewed join is split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b) with a > b."""
    if large:  # of all neighbours, the larger ones move
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("m", "a").alias("m"))
        moved = links.join(least, links.b == least.v).select("a", "m")  # from b, a larger neighbour
    else:  # of the smaller neighbours, all but the least move
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        joined = links.join(least.withColumnRenamed("a", "v"), F.col("a") == F.col("v"))
        moved = joined.where("b <> m").select(F.col("b").alias("a"), "m").unionByName(least.select("a", "m"))
    return moved.where("a <> m").select("a", F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots themselves."""
    def sign(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    d = C.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = sign(d)
    while before[0]:
        d = C.stored(_star(C.stored(_star(d, True), "large"), False), "small")
        after = sign(d)
        if after == before:
            break
        before = after
    return d.select(F.col("a").alias("node"), F.col("b").alias("root"))
