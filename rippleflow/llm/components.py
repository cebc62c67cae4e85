"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.session import cut_lineage

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (src, dst); the label is the least node reached.

    A large star hangs every greater neighbour of a node on the node's least neighbour, a small
    star does so with the lesser ones; both keep the components and a logarithmic number of rounds
    leaves stars. Minima are combined before the shuffle and joined back, so no neighbourhood is
    gathered, and each round ends in a checkpoint.
    """
    edges = links.where("src <> dst").select(
        F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).distinct()
    edges = cut_lineage(edges)
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        # every row of ``large`` points from the greater to the lesser node
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        edges = cut_lineage(
            small.select(F.col("v"), F.col("m").alias("u"))
            .union(small.select(F.col("u").alias("v"), F.col("m").alias("u")))
            .where("v <> u").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
