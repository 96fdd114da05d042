"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import Scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has a link; component is the smallest node id of the component.

    Alternating star contraction: each round joins every node's larger neighbours to its smallest neighbour, then the
    smaller ones, until no link changes; the rounds grow with the logarithm of the longest chain. All aggregates combine on the map
    side, so a hub with a third of all links sends one row a task. Each round is written to the shared folder.
    Null ends and self links are ignored, repeated links count once; no links give no rows. `max_rounds` guards against
    a logic error only: reaching it raises instead of returning unfinished components.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = scratch.keep(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour (and the node itself) points to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour and the node itself point to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        )
        new = scratch.keep(small)
        # done once every node has one parent and no parent has a parent
        old_sig, sig = _signature(edges), _signature(new)
        scratch.drop(edges)
        edges = new
        if sig == old_sig:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _signature(edges: DataFrame) -> tuple:
    """Two numbers for an edge set, computed in one distributed pass."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
