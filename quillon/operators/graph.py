"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate and an equi join on node ids, so a hub's edges are never collected into one
row, and AQE may split a hub's partition. Each round's edges are a written table, so a lost executor costs a
re-read of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import materialize

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns node, root for every node that isn't the smallest of its component.

    Self loops, repeated edges and either direction are accepted; rows with a null end are ignored; an empty
    table gives an empty result.
    """
    star = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _signature(star)
    for _ in range(MAX_ROUNDS):
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(parent, "a").select(F.inline(ends)).where("a <> b").distinct()
        star = materialize(small, "edges")
        if (now := _signature(star)) == seen:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
