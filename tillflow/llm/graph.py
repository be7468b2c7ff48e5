"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.session import materialise


def seal_of(links: DataFrame) -> tuple:
    """Count and combined hash of distinct links: equal for equal tables."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``links`` (``a, b``) reaches.

    Links are replaced by links to smaller nodes in alternating rounds: every node's neighbours that are larger,
    then those that are smaller, are linked to its smallest neighbour. Stars remain after about as many rounds
    as the logarithm of the longest path. Only minima by node are gathered, never a node's neighbours, and the
    driver sees counts alone.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "links")
    sealed = seal_of(links)
    while True:
        sides = links.select(F.explode(both).alias("e")).select("e.*")
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = materialise(sides.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                            .filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        fresh = materialise(
            small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct(), "links")
        seal, links = seal_of(fresh), fresh
        if seal == sealed:
            break
        sealed = seal
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    tops = links.select(F.col("b").alias("node")).distinct().join(roots, F.col("node") == roots["a"], "left_anti")
    return roots.select(F.col("a").alias("node"), "root").unionByName(tops.select("node", F.col("node").alias("root")))
