"""Connected components of an edge table, by large-star and small-star steps (Kiveris et al., 2014).

Every round is two joins of the edges with the smallest neighbour of each node; edges and labels stay in tables.  Each
round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, stashed


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b: long) but the smallest ones.

    Self loops, repeated edges and either direction are fine; no edges give an empty table.
    """
    c = F.col
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = edges.sparkSession
    edges, path = stashed(edges, name)
    before = _signature(edges)
    while before[0]:
        # large star: neighbours above a node hang on the smallest of its neighbourhood
        both = edges.select("a", "b").unionByName(edges.select(c("b").alias("a"), c("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(c("b").alias("a"), c("m").alias("b")).distinct()
        # small star: a node and its neighbours below hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(c("b").alias("a"), c("m").alias("b")).unionByName(low.select("a", c("m").alias("b")))
        edges, now = stashed(small.where("a <> b").distinct(), name)
        remove(spark, path)  # the round before is not read again
        path, after = now, _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(c("a").alias("node"), c("b").alias("label"))
