"""Connected components by alternating stars: each round is two grouped minima and two equi-joins, written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import join_groups, table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Of each node its smallest neighbour and its number of edges."""
    return table(edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node but the roots; the root is the component's smallest node. Ends when a round changes nothing."""
    e = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct()
    e = table(e, "edges")
    was = _state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # (hi: node, lo: neighbour)
        least = _least(both).withColumn("m", F.least("hi", "m"))
        large = table(join_groups(both.where("lo > hi"), least, ["hi"], "n", total=2 * was[0]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        least = _least(large)
        small = join_groups(large, least, ["hi"], "n", total=2 * was[0]).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = table(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
