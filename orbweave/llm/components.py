"""Connected components of a graph of links, as repeated star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.storage import discard, stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the least node of its component. Only linked nodes have rows.

    Each round links all larger neighbours of a node, then all smaller ones, to its least neighbour, until nothing
    changes; every round is written to the shared folder. The driver sees two numbers a round. The least neighbours are
    written before they are joined, so that a hub's links lie in a shuffle of the join's own, which Spark can split.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "links-0")
    state = _state(pairs)
    for k in range(most):
        if not state[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"links-{k}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), f"links-{k}-large")
        discard(low)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = pairs
        pairs = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"links-{k}-small")
        before, state = state, _state(pairs)
        discard(old, large)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    root = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
