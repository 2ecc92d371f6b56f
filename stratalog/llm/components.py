"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, materialise, salt_bit, salt_of, salts_in

#: The links of one node are dealt to so many tasks.
SALTS = 32


def _to_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m) of the links (u, v, salt): m is the least of u. A node meets its least in as many tasks as its links have salts."""
    dealt = least.select("u", "m", F.explode(salts_in(F.col("mask"), SALTS)).alias("salt"))
    return links.join(dealt, ["u", "salt"])


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(salt_bit(F.col("salt"))).alias("mask"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links; root is the smallest node that it reaches. Self-links and repeats do no harm; no links give no rows.

    Each step re-links a node's neighbours to the smallest node of their star, so stars only shrink towards roots: no
    neighbourhood is gathered, a minimum and a join by node are all it takes. The links of a hub are dealt out by salts of
    their other ends, both for the minimum and for the join. Tables in the shared folder cut the lineage.
    """
    edges = materialise(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u > v").distinct(), "links")
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("salt", salt_of(F.col("v"), SALTS))
        least = _least(both).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour of u goes to u's minimum
        large = _to_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().withColumn("salt", salt_of(F.col("v"), SALTS))
        # small star: u and its smaller neighbours go to the smallest of them
        low = _to_least(large, _least(large))
        small = low.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        new = materialise(small, "links")
        moved = new.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        done_with(edges)
        edges = new
        if not moved:
            break
    else:
        raise RuntimeError(f"the components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
