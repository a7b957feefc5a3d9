"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.phases import phase


def _low_high(edges: DataFrame) -> DataFrame:
    """Distinct links as (hi, lo), without loops."""
    ordered = edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
    return ordered.where(F.col("hi") != F.col("lo")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has larger ones."""
    ends = links.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("ups")),
                                          F.struct(F.col("lo").alias("node"), F.lit(0).alias("ups")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("ups").alias("ups"), F.min("ups").alias("least"))
    return nodes.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of a link.

    Alternates two steps until nothing changes: each node sends its larger
    neighbours, then its smaller ones, to the smallest neighbour it knows.  The
    number of rounds grows with the logarithm of the longest chain.  Minima are
    combined before they are shuffled, and a node with very many links is only ever
    the key of a join, which adaptive execution splits.  Null ends are ignored; no
    links give no rows.
    """
    current = phase(_low_high(edges.select(F.col(left).alias("hi"), F.col(right).alias("lo"))), "links")
    while not _are_stars(current):
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        smallest = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("to"))
        larger = both.where("lo > hi").join(smallest, "hi").select(F.col("lo").alias("hi"), F.col("to").alias("lo"))
        large = phase(_low_high(larger), "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("to"))
        moved = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("to").alias("lo"))
        kept = least.select("hi", F.col("to").alias("lo"))
        current = phase(_low_high(moved.unionByName(kept)), "links")
    stars = current.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    centres = current.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.unionByName(centres)
