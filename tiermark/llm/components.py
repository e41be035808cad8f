"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """The component of every node that has a link.

    links: columns a and b (long), in any order, repeated or not; a link of a node
    with itself counts for nothing, nor does one with a null end. Returns node and
    component (long), the smallest node reachable. An empty table gives an empty one.

    Each round hangs every node's larger neighbours below its smallest one, then its
    smaller neighbours too, so stars form in a number of rounds that grows with the
    logarithm of the number of nodes. Minima are summed before the shuffle, and the
    joins are plain ones, which Spark splits where a node has very many neighbours.
    """
    links = links.where("a is not null and b is not null and a != b")
    stars = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state or not now[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # kept apart from the sum that made it, so that Spark can split the join where one node has very many neighbours
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = checkpoint(small.union(smallest.select("a", F.col("m").alias("b"))).distinct())
