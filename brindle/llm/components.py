"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import checkpoint_folder


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """Each linked node (columns ``a``, ``b`` of ``links``) as ``node`` with ``component``.

    ``component`` is the least node that is reached. Links are turned towards lesser nodes,
    by turns for a node's greater neighbours and for its lesser ones, until every node points
    at the least of its component. The table never grows beyond the links; a node's
    neighbours are reduced to their minimum and never gathered. The number of rounds grows
    with the logarithm of the longest path. Null ends and links to oneself are left out.
    """
    checkpoint_folder(links.sparkSession)
    known = (links.where("a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct().checkpoint())
    before = None
    while True:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        greater = (both.where(F.col("v") > F.col("u")).join(least, "u")
                   .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _least(greater)
        pointed = greater.join(least, "u")
        known = (pointed.where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v"))
                 .distinct().checkpoint())
        now = known.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                        F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    roots = known.select(F.col("v").alias("node")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node")))
