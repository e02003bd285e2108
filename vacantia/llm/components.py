"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _oriented(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node that stands in ``links`` (a, b: long).

    Alternating large and small stars: in each round every node hands its neighbours to the smallest of them, which
    is an aggregate (min) and an equality join.  The rounds, about the logarithm of the longest chain, are written
    to the shared folder; they end when the links no longer change.  Null ends are no links."""
    links = stored(_oriented(links.dropna()))
    mark = None
    while mark != (mark := links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _oriented(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        links = stored(_oriented(small))
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(
        links.select("b", "b").distinct())
